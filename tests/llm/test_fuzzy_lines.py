"""Line dedup on every line length: recall of links, exactness, odd columns."""

import random

import brute
import pytest

from tripmine.llm import fuzzy_lines


def word(rng, low, high):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(low, high + 1)))


def edited(rng, line, edits):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = rng.choice("QRS")
    return "".join(out)


def similarity(a, b):
    a, b = brute.chars(a), brute.chars(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("length", [60, 150, 300, 1000])
def test_recall_on_every_line_and_word_length(spark, length):
    rng = random.Random(length)
    rows, pairs = [], []
    for low, high in ((1, 4), (3, 9), (9, 15), (15, 24), (60, 90)):
        while sum(p[0] == low for p in pairs) < 120:
            line = word(rng, low, high)
            while len(line) < length:
                line += " " + word(rng, low, high)
            other = edited(rng, line, max(1, length // 90))
            if 0.8 <= similarity(line, other) < 0.9 or length < 100 and similarity(line, other) >= 0.8:
                pairs.append((low, len(rows), len(rows) + 1))
                rows += [(len(rows), line), (len(rows) + 1, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs).collect()}
    for low in (1, 3, 9, 15, 60):
        found = [kept[b] == "" for n, a, b in pairs if n == low]
        assert sum(found) / len(found) >= 0.97, (length, low, sum(found) / len(found))
    assert all(kept[a] for _, a, b in pairs)


def test_families_in_one_band_hide_no_link(spark):
    """Hundreds of lines with one long beginning, in pairs that are alike."""
    rng = random.Random(3)
    stem = " ".join(word(rng, 3, 8) for _ in range(22))
    rows = []
    for i in range(150):
        line = f"{stem} {' '.join(word(rng, 3, 8) for _ in range(9))}"
        rows += [(2 * i, line), (2 * i + 1, line[:-1] + "Q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs).collect()} == brute.kept_lines(rows)


def test_large_buckets_are_split(spark):
    """Buckets far above what a task settles: one family, and lines that only begin alike."""
    rng = random.Random(6)
    stem = " ".join(word(rng, 3, 8) for _ in range(30))
    lines = [f"{stem} {word(rng, 3, 3)}" for _ in range(120)]
    lines += [f"{stem} {' '.join(word(rng, 3, 8) for _ in range(8))}" for _ in range(80)]
    lines += [line[:-1] + "Q" for line in lines[120:]]
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = fuzzy_lines.as_table(fuzzy_lines.signed_lines(docs))
    names = {r.name: rows[r.doc_id][1] for r in signed.collect()}
    found = fuzzy_lines.links(docs, signed, bucket=8).collect()
    assert all(similarity(names[r.a], names[r.b]) >= 0.8 - 1e-9 for r in found)
    sets = [(n, brute.chars(t)) for n, t in names.items()]
    every = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if len(s & t) >= 0.8 * len(s | t) - 1e-9]
    parts = [len(set(brute.components(names, x).values())) for x in (every, [(r.a, r.b) for r in found])]
    assert parts[1] - parts[0] <= 2  # of 160 links between families
    assert len(found) <= fuzzy_lines.LEADERS * 2 * fuzzy_lines.BANDS * len(names)


def test_long_lines_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        line = " ".join(word(rng, 15, 24) for _ in range(15))
        rows += [(3 * i, line), (3 * i + 1, edited(rng, line, 2)), (3 * i + 2, edited(rng, line, 9))]
    rows += [(900, "字" * 400 + "甲乙丙"), (901, "字" * 399 + "甲乙丙"), (902, "abc"), (903, "abc\nabcd"), (904, "x " * 60_000), (905, "x " * 60_000 + "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs).collect()} == brute.kept_lines(rows)


def test_columns_of_any_name_are_kept(spark):
    schema = "doc_id int, text string, _gone string, _lines string, _gone_id int, Name string, n_chars bigint"
    rows = [(1, "one line", "g", "l", 5, "n", 8), (2, "one line\nmine", "h", "m", 6, "o", 13), (2, "one line\nmine", "i", "k", 7, "p", 13)]
    found = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, schema))
    assert found.schema == spark.createDataFrame([], schema).schema or found.columns == [f.split()[0] for f in schema.split(", ")]
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "one line", "g", "l", 5, "n", 8), (2, "mine", "h", "m", 6, "o", 4), (2, "mine", "i", "k", 7, "p", 4)
    ]


@pytest.mark.parametrize("unlike", [0, 40])
def test_buckets_the_last_level_leaves_open_are_compared_whole(spark, monkeypatch, unlike):
    """Every pair of lines that share a band is compared or joined, also where leaders say nothing of it."""
    monkeypatch.setattr(fuzzy_lines, "LEVELS", fuzzy_lines.LEVELS[:1])
    rng = random.Random(8)
    stem = " ".join(word(rng, 3, 8) for _ in range(24))
    lines = [f"{stem} {' '.join(word(rng, 3, 8) for _ in range(9))}" for _ in range(unlike or 4)]
    # chains, whose ends are alike to their neighbours alone
    for line in list(lines):
        for _ in range(2 if unlike else 12):
            line = edited(rng, line, 3)
            lines.append(line)
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = fuzzy_lines.as_table(fuzzy_lines.signed_lines(docs))
    bands = {r.name: (set(r.bands), brute.chars(rows[r.doc_id][1])) for r in signed.collect() if r.bands}
    found = [(r.a, r.b) for r in fuzzy_lines.links(docs, signed, bucket=6).collect()]
    every = [(a, b) for a, (x, s) in bands.items() for b, (y, t) in bands.items() if a < b and x & y and len(s & t) >= 0.8 * len(s | t) - 1e-9]
    assert brute.components(bands, found) == brute.components(bands, every)


def test_links_given_grow_with_the_lines_of_a_family(spark, monkeypatch):
    """Lines that are joined already are not linked anew in every two blocks of an open bucket."""
    monkeypatch.setattr(fuzzy_lines, "LEVELS", fuzzy_lines.LEVELS[:1])
    rng = random.Random(12)
    stem = " ".join(word(rng, 3, 8) for _ in range(30))
    lines = [f"{stem} {word(rng, 4, 4)}" for _ in range(160)]
    lines += [f"{stem} {' '.join(word(rng, 3, 8) for _ in range(9))}" for _ in range(8)]
    lines += [line[:-1] + "Q" for line in lines[160:]]
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = fuzzy_lines.as_table(fuzzy_lines.signed_lines(docs))
    write, given = fuzzy_lines.as_table, []

    def written(df, name="table"):
        table = write(df, name)
        if name == "links":
            given.append(table.count())
        return table

    monkeypatch.setattr(fuzzy_lines, "as_table", written)
    found = [(r.a, r.b) for r in fuzzy_lines.links(docs, signed, bucket=6).collect()]
    assert sum(given) <= 20 * len(lines)
    texts = {r.name: lines[r.doc_id] for r in signed.collect()}
    parts = brute.components(texts, found)
    first = {}
    for name, text in texts.items():
        first.setdefault(parts[name], []).append(text)
    assert max(map(len, first.values())) == 160


def test_places_leave_out_no_pair_that_is_alike():
    rng = random.Random(13)
    stem = [word(rng, 2, 8) for _ in range(60)]
    lines = {}
    for name in range(90):
        words = list(stem)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(60)] = word(rng, 2, 8)
        lines[name] = " ".join(words)
    lines |= {100: "abc", 101: "abc" * 300, 102: "abc" * 299, 103: "字" * 20}
    sets = [fuzzy_lines.shingle_set(t) for t in lines.values()]
    maybe = fuzzy_lines.may_be_alike(sets)
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if fuzzy_lines.alike(sets[i], sets[j])]
    assert all(maybe[i, j] for i, j in pairs) and len(pairs) < maybe.size / 2
    names = list(lines)
    every = [(names[i], names[j]) for i, j in pairs if i != j]
    assert brute.components(names, fuzzy_lines.family_links(lines)) == brute.components(names, every)
