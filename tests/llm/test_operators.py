"""Each operator against a plain version, and on nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import math
import random
import re

import brute
import pytest

from tripmine.llm import (
    chat,
    decontaminate,
    fuzzy_lines,
    html_text,
    impact_index,
    kneser_ney,
    licenses,
    mixing,
    queries,
    sanitise,
    token_groups,
)

DOCS = "doc_id bigint, text string, lang string, mark string, name string, rate string, _words string"
LABELS = "doc_id bigint, quality bigint, toxic bigint"


def corpus(spark, *rows):
    """Documents of (id, text), with other columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "en", "m", "n", "r", "w") for r in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(("river", "stone", "cloud", "paper", "green", "light", "seven")) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def near():
    """Documents with near copies, repeats, ties, null, empty, blank, short and very long texts."""
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Two words"), (5, "two WORDS"), (6, "other words")]
    for i in range(25):
        words = prose(rng, rng.choice((20, 60, 200))).split()
        rows.append((100 + 10 * i, " ".join(words)))
        for j in range(1, 4):
            changed = list(words)
            for _ in range(j * len(words) // 60):
                changed[rng.randrange(len(changed))] = "changed"
            rows.append((100 + 10 * i + j, " ".join(changed)))
    long = prose(rng, 30_000)
    return [*rows, (900, long), (901, long + " more"), (902, long)]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, near, words, percent):
    found = token_groups.link_components(corpus(spark, *near), words=words, percent=percent)
    assert {tuple(r)[:3] for r in found.select("doc_id", "n_shingles", "component_id").collect()} == brute.linked_components(
        near, words, percent
    )


def test_ngram_join_of_repeated_rows_and_nothing(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (8, "a b c d e")]
    found = token_groups.link_components(corpus(spark, *rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(7, 7), (7, 7), (8, 7)]
    assert token_groups.link_components(corpus(spark)).collect() == []


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "漢字仮名交じり文" * 20 + "甲"), (5, "漢字仮名交じり文" * 20 + "乙")]
    rows += [(10 + i, f"Read more about the thing here, number {i % 7}\n\n{prose(rng, 9)}\n{'x' * (200 + i)}") for i in range(20)]
    for i in range(40):
        line = prose(rng, rng.choice((12, 17, 25, 80)))
        other = list(line)
        for _ in range(max(1, len(line) // 110)):
            other[rng.randrange(len(other))] = "Q"
        rows += [(100 + 2 * i, line), (101 + 2 * i, "".join(other) + "\nsame line in all\n")]
    docs = corpus(spark, *rows)
    found = fuzzy_lines.dedup_lines(docs)
    assert found.columns == docs.columns
    assert {r.doc_id: r.text for r in found.collect()} == brute.kept_lines(rows)
    assert fuzzy_lines.dedup_lines(corpus(spark)).collect() == []


def test_lines_of_repeated_rows_and_null_ids(spark):
    found = fuzzy_lines.dedup_lines(corpus(spark, (None, "one line"), (1, "one line\nmine"), (1, "one line\nmine"))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found) == [(0, "one line"), (1, "mine"), (1, "mine")]


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 5 + 3 * i)) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (0, prose(rng, 9))]
    rows = [(1, None), (2, ""), (3, "short")]
    for i in range(30):
        words = items[i % 12][1].split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
        rows.append((10 + i, f"{prose(rng, rng.choice((0, 50, 20_000)))} {' '.join(words)} {prose(rng, 30)}"))
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id bigint")
    expected = []
    for d, text in rows:
        have = brute.word_shingles(text, 5)
        for i, item in items:
            want = brute.word_shingles(item, 5)
            if want and 10 * len(want & have) >= 8 * len(want):
                expected.append((d, i, len(want), len(want & have)))
    for block in (8_000_000, 500):
        found = decontaminate.contained_items(corpus(spark, *rows), table, block_bytes=block).collect()
        assert sorted(tuple(r)[:4] for r in found) == sorted(expected)
    assert decontaminate.contained_items(corpus(spark), table).collect() == []
    assert decontaminate.contained_items(corpus(spark, *rows), table.limit(0)).collect() == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(ds):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(ds))) % 10 == 0

    def sound(kind, m):
        ds = re.sub("[^0-9]", "", m)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
            "card": lambda: 12 <= len(ds) <= 19 and luhn(ds),
            "phone": lambda: 9 <= len(ds) <= 15,
        }[kind]()

    spans = [
        (m.start(), k, f"{n}:{m.start()}:{m.end()}")
        for k, (n, p) in enumerate(BASE.items())
        for m in re.finditer(p, text or "")
        if sound(n, m[0])
    ]
    return ",".join(s for _, _, s in sorted(spans))


def test_entities_equal_the_patterns(spark):
    rng = random.Random(8)
    signs = ["@", ".", "-", " ", "+", "a.b", "x@y.z", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (30) 1234-567", "a%", "12", "é", "\n", "@mail.example.com", "1.2.3.4.5.6.7.8", "@@", "..", "--", "٣"]
    rows = [(1, None), (2, ""), (3, "a" * 200_000 + "@b.cd"), (4, "1" * 100_000)]
    rows += [(10 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))) for i in range(600)]
    found = {r.doc_id: r for r in sanitise.sanitise(corpus(spark, *rows)).collect()}
    for i, text in rows:
        assert found[i].base == base_spans(text), text
        assert set(filter(None, found[i].base.split(","))) <= set(found[i].spans.split(","))
    assert sanitise.sanitise(corpus(spark)).collect() == []


def test_terms_that_disclose_are_removed(spark):
    lines = [f"the quick note number {chr(97 + i)} {chr(98 + i)}{chr(97 + i)}" for i in range(20)] * 20
    marked = [f"Zorbulon said {w} to the man at z@example.com today" for w in ("yes", "no", "perhaps", "never")]
    rows = [(1, "\n".join(lines)), (2, "\n".join(marked)), (3, "only z@example.com and the Zorbulon"), (3, "the Zorbulon alone")]
    found = sanitise.sanitise(corpus(spark, *rows)).collect()
    clean = {(r.doc_id, r.clean) for r in found}
    assert (3, "only [email] and the ") in clean and (3, "the Zorbulon alone") in clean
    assert "Zorbulon" not in next(c for d, c in clean if d == 2)
    assert " the " in next(c for d, c in clean if d == 2)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", r"\z\a #: \ </turn>"), (2, 0, "assistant", None),
            (2, 1, None, ""), (None, 0, "user", "x"), (3, 5, "user", "same"), (3, 5, "user", "same"), (4, 0, "user", "l" * 300_000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, valid int")
    chats = chat.format_chats(turns)
    from pyspark.sql import functions as F

    back = chats.select("conv_id", "valid", chat.read_turns(F.col("formatted")).alias("t"),
                        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in back:
        own = sorted((n, role or "", text or "") for c, n, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.t] == [(role, text) for _, role, text in own]
        assert r.loss == "".join(text for _, role, text in own if role == "assistant")
    assert {r.conv_id: r.valid for r in back}[1] and not {r.conv_id: r.valid for r in back}[2]
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_top_k_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice((-1.0, 0.5, rng.uniform(-1, 1))) for _ in range(8)]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None] + [0.0] * 6), (440, [math.nan] * 8), (460, [math.inf] * 8), (None, [0.0] * 8), (7, rows[7][1])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, score int")
    vectors = impact_index.quantised(table)
    found = impact_index.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()
    held = [(r.vec_id, r.v) for r in vectors.collect()]
    expected = set()
    for q, v in held:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in held if i != q))[:20]
            expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in found} == expected
    assert impact_index.top_k(vectors.limit(0), vectors.limit(0)).collect() == []
    few = vectors.where("vec_id < 3")
    assert len(impact_index.top_k(few, few.where("vec_id = 0")).collect()) == 2


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><header>Site, head</header>
<article><h1>Title</h1><p>First, long paragraph of text, with commas &amp; more&nbsp;words to read here.</p>
<p>Second   one,
is here, too, with <b>bold</b> words in it.</p><script>var a="x,y,z"</script></article>
<aside>Side, bar, text</aside><div class="comments"><p>I, the reader, say, this, and, that.</p></div><footer>Foot, er</footer></body>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>only <b>broken"), (4, "u", "<p>only <b>broken"),
            (5, "u", "<article>" + "<p>Some, text, again.</p>" * 5000 + "</article>"), (6, "u", "<div>" * 5000 + "deep, text" + "</div>" * 5000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert found[1].text == ("Title\n\nFirst, long paragraph of text, with commas & more words to read here.\n\n"
                             "Second one, is here, too, with bold words in it.")
    assert (found[2].text, found[3].text, found[4].text) == ("", "", "only broken")
    assert found[5].text == "\n\n".join(["Some, text, again."] * 5000) and found[6].text == "deep, text"
    assert all(r.n_chars == len(r.text) for r in found.values())
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.limit(0)).collect() == []


def longest_common_in_order(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] = max([1] + [best[j] + 1 for j in range(i) if pairs[j][1] < pairs[i][1]])
    return max(best, default=0)


def test_patience_takes_the_longest_increasing_run():
    rng = random.Random(2)
    for _ in range(200):
        a = rng.sample(range(30), rng.randrange(1, 12))
        b = rng.sample(range(30), rng.randrange(1, 12))
        found = licenses.patience([str(x) for x in a], [str(x) for x in b])
        assert all(a[i] == b[j] for i, j in found)
        assert found == sorted(found) and len({j for _, j in found}) == len(found)
        anchors = [(a.index(x), b.index(x)) for x in a if x in b]
        assert len(found) == longest_common_in_order(sorted(anchors))


def test_licenses(spark):
    notice = licenses.TEMPLATES["apache-2.0-notice"]
    cut = " ".join(w for i, w in enumerate(notice.split()) if i % 12)
    rows = [(1, None), (2, ""), (3, "no license here"), (4, f"x y z {notice} and {'word ' * 50_000} {notice}"), (5, cut.upper()), (5, cut.upper())]
    found = [r for r in licenses.scan(corpus(spark, *rows)).collect() if r.license == "apache-2.0-notice"]
    assert sorted((r.doc_id, r.coverage == 1.0) for r in found) == [(4, True), (4, True), (5, False), (5, False)]
    assert licenses.scan(corpus(spark)).collect() == []


def test_counts_are_all_character_grams(spark):
    texts = ["ab ab", "xyz 12", "", None, "ab ab"]
    docs = corpus(spark, *enumerate(texts)).select("text")
    total = sum(len(kneser_ney.keys(kneser_ney.units(t))) for t in texts if t)
    found = kneser_ney.counts(docs)
    assert found.agg({found.columns[-1]: "sum"}).first()[0] == total


def test_quality_of_held_out_text(spark):
    rng = random.Random(1)
    rows = [(i, ". ".join(prose(rng, 12) for _ in range(5))) for i in range(120)]
    rows += [(200 + i, "".join(chr(rng.randrange(33, 0x2FF)) for _ in range(400))) for i in range(6)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, prose(rng, 9000)), (304, rows[0][1]), (304, rows[0][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(None, 1, 0), (5, 1, 0), (9999, 1, 0)], LABELS)
    docs = corpus(spark, *rows)
    kept = kneser_ney.without_rejected(docs, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(ids) == [*range(120), 303, 304, 304]
    without = kneser_ney.without_rejected(docs, labels.limit(0)).collect()
    assert {r.doc_id for r in without} == {i for i, t in rows if t and t.strip()}
    assert kneser_ney.without_rejected(docs.limit(0), labels).collect() == []


def test_mixture_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40)) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(("hate", "vile", "scum", "trash")) for _ in range(40))) for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, prose(rng, 20_000)), (3, rows[3][1])]
    marks = [(i, 1, 0) for i in range(200)] + [(1000 + i, 1, 1) for i in range(60)] + [(None, 1, 0), (3, 1, 0), (3, None, None)]
    labels = spark.createDataFrame(marks, LABELS)
    weights = {"good": 0.9, "poor": 0.0, "toxic": 0.1}
    found = mixing.mixed(corpus(spark, *rows), labels, weights, 1.0).toPandas()
    assert len(found) == len(rows)
    held_out = found[found.doc_id.between(1060, 1080)]
    assert (held_out.p_toxic > 0.9).all() and (found[found.doc_id.between(200, 299)].p_good > 0.9).all()
    tokens = found.n_tokens.sum()
    for d, w in weights.items():
        assert abs((found.rate * found.n_tokens * found[f"p_{d}"]).sum() / tokens - w) < 0.02
    assert (found.rate >= 0).all() and ((found.copies - found.rate).abs() < 1).all()
    assert found[found.doc_id == 3].copies.nunique() == 1
    plain = mixing.mixed(corpus(spark, *rows), labels.limit(0)).toPandas()
    assert (plain.rate == 1).all() and plain.p_good.isna().all()
    assert mixing.mixed(corpus(spark), labels).collect() == []


def test_queries_are_named_after_their_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_pii_query_digests(spark, sf_dir):
    found = {r.doc_id: r for r in queries.QUERIES["op2_pii"](spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for r in texts:
        assert found[r.doc_id].base_sha256 == hashlib.sha256(base_spans(r.text).encode()).hexdigest()
