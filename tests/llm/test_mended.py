"""Cases in which operators once failed or lost rows."""

import math
import random
from collections import Counter

from tripmine.llm import chat, html_text, kneser_ney, licenses, sanitise, token_groups

DOCS = "doc_id bigint, text string"


def test_repeated_and_null_ids_lose_no_link(spark):
    rng = random.Random(1)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
    rows = [(7, text[0]), (7, text[1]), (8, text[0] + " one"), (9, text[1] + " two"), (None, text[2]), (20, text[2] + " more"), (21, text[2] + " and")]
    found = token_groups.link_components(spark.createDataFrame(rows, DOCS), words=4, percent=85).collect()
    ids = {r.doc_id: r.component_id for r in found}
    assert (ids[7], ids[8], ids[9]) == (7, 7, 7) or (ids[8], ids[9]) == (7, 7)
    assert ids[20] == ids[21] == ids[None] == 20


def test_an_entity_in_every_line_discloses_nothing(spark):
    rows = [(i, f"Zorb wrote to z@example.com today {w}") for i, w in enumerate(("once", "again", "twice"))]
    found = sanitise.sanitise(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.n_email == 1 and "[email]" in r.clean for r in found)
    rows = [(1, "a z@example.com b z@example.com c z@example.com d z@example.com")]
    assert sanitise.sanitise(spark.createDataFrame(rows, DOCS)).first().n_email == 4


def test_broken_markup():
    text = html_text.main_text
    body = "<article><p>One, two, three, a long enough paragraph of the text here.</p>{}<p>Four, five, six, and seven are next.</p></article>"
    whole = text(body.format(""))
    for mark in ("<![foo[ bar]]>", "<![if IE]>", "<![CDATA[ x ]]>", "<!DOCTYPE [ <!x> ]>"):
        assert text(body.format(mark)).startswith("One, two") and "Four, five" in text(body.format(mark))
    for tail in ("<!-- never closed", "<?php echo 1", "<![foo[ bar", "<!doctype"):
        assert text(body.format("") + tail) == whole
    assert "E = mc" in text(body.format("<p>Where <math><mi>E</mi> = <mi>mc</mi></math> holds, as said, in general.</p>")).replace("E =  mc", "E = mc")


def test_notices_side_by_side():
    name = next(n for n, t in licenses.TEMPLATES.items() if "MIT" in t)
    template = licenses.Template(name, licenses.TEMPLATES[name], 0.8)
    for k in (1, 2, 3, 5, 20, 3000):
        found = template.words * k
        places = {}
        for at, w in enumerate(found):
            places.setdefault(w, []).append(at)
        hits = template.scan(found, places)
        assert [(h[3], h[4]) for h in hits] == [(i * len(template.words), (i + 1) * len(template.words)) for i in range(k)]


def test_only_control_strings_are_escaped(spark):
    texts = ["plain text: with # signs and spaces", "a ### b", "x </turn>\n y", "x </turn>", "\\a \\z ### </turn>\n", ""]
    rows = [(i, 0, role, t) for i, t in enumerate(texts) for role in ("user",)] + [(50, 0, "odd: role ### ", "t"), (51, 0, "r </turn>\n:", "t")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    from pyspark.sql import functions as F

    for r in chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t")).collect():
        role, text = next((x[2], x[3]) for x in rows if x[0] == r.conv_id)
        assert [(t.role, t.text) for t in r.t] == [(role, text)]
        if r.conv_id in (0, 3):
            assert r.formatted == f"### user: {text} </turn>\n"


def plain_kneser_ney(trusted, text):
    """Sum of natural log probabilities of a text, from counts in dictionaries."""

    def grams(t):
        u = kneser_ney.units(t).tolist()
        return [tuple(u[i - 3 : i + 1]) for i in range(3, len(u))]

    count = {4: Counter(g for t in trusted for g in grams(t))}
    for n in (3, 2, 1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    discount, total, weight = {}, {}, {}
    for n, c in count.items():
        of = [max(1, sum(v == i for v in c.values())) for i in range(1, 5)]
        y = of[0] / (of[0] + 2 * of[1])
        ds = [min(max(i + 1 - (i + 2) * y * of[i + 1] / of[i], 0.05), i + 0.95) for i in range(3)]
        discount[n] = lambda v, ds=ds: ds[min(v, 3) - 1]
        total[n], lost = Counter(), Counter()
        for g, v in c.items():
            total[n][g[:-1]] += v
            lost[g[:-1]] += discount[n](v)
        weight[n] = {ctx: lost[ctx] / total[n][ctx] for ctx in lost}
    uniform = 1 / (len(count[1]) + 1)

    def p(g):
        n = len(g)
        if n == 0:
            return uniform
        low, ctx = p(g[1:]), g[:-1]
        if ctx not in weight[n]:
            return low
        seen = (count[n][g] - discount[n](count[n][g])) / total[n][ctx] if g in count[n] else 0.0
        return seen + weight[n][ctx] * low

    return sum(math.log(p(g)) for g in grams(text)), len(grams(text))


def test_scores_equal_a_plain_model(spark, monkeypatch):
    rng = random.Random(2)
    trusted = ["".join(rng.choice("abcde f") for _ in range(rng.randrange(5, 80))) for _ in range(30)] + ["été 漢字 été", "x"]
    rows = [*enumerate(trusted), (100, "abc fed zzz"), (101, "漢字漢 qqq"), (102, "a a a a 12 34"), (103, "e" * 300)]
    docs = kneser_ney.marked(spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string"))
    table = kneser_ney.model(kneser_ney.counts(docs.where("doc_id < 100").select("text")))
    for size in (kneser_ney.SHARD, 40):
        monkeypatch.setattr(kneser_ney, "SHARD", size)
        found = {r.doc_id: (r.s, r.u) for r in kneser_ney.log_perplexity(docs, table).collect()}
        for i, t in rows:
            s, u = plain_kneser_ney(trusted, t)
            assert found[i][1] == u and abs(found[i][0] - s) < 1e-6 * max(1, abs(s)), (t, found[i], s)
