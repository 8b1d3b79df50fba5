"""Mixing documents to target domain weights by soft membership, with SQL functions only.

Domains are ``good``, ``poor`` and ``toxic``, as the label table marks documents. A
naive Bayes classifier, fitted on at most ``SAMPLE`` labelled documents (those of
smallest hash), gives each document a posterior over domains, from the ``WORDS``
words that tell domains apart best by G-test among those at least ``LIFT`` times as
frequent in one domain as overall and beyond chance, and from classes of its form (capitals, symbols,
repetition). Words speak where they occur; that one is missing says more about the
length of a text. Every document is scored on its whole text.

Document rates r >= 0 then solve the least-squares problem

    min sum_k (sum_d r_d tokens_d p_dk - T_k)^2,   T_k = size * weight_k * all tokens

by accelerated projected gradient from r = 1. The gradient step is taken in the
metric of token counts, so rates depend on the posterior alone; documents whose
posteriors fall into one of at most 561 cells (steps of 1/32) move together, with
the exact token sums of the cell. The cells are one distributed aggregate; each
iteration is one more over them.

A document of rate r gets floor(r) copies, and one more with probability equal to
the rest, decided by its hash. Null, blank and empty texts have no tokens; their
posterior is that of a text without any of the words. Documents that share id and
text get the same rate and copies. Labels that are null, repeated or of unknown
documents add nothing; where labels say different things of one document, toxic
wins, then poor. Without labelled documents there are no posteriors (null) and all
rates are 1. Other columns are passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine.llm.ids import sized
from tripmine.workspace import as_table

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.94, "poor": 0.02, "toxic": 0.04}
SIZE = 1.25
SAMPLE, WORDS, LIFT, STEPS = 20_000, 128, 2.5, 32
#: Least G: chance alone gives it to one word in a billion.
SURE = 40.0
ITERATIONS, TOLERANCE = 80, 1e-4
#: Seen in a text that has none of the chosen words.
QUIET = "quiet="


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _tokens(text: Column) -> Column:
    """Words between white space."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def _form(text: Column, different: Column, tokens: Column) -> Column:
    """Classes of form: shares of capitals, of symbols, of words that are repetitions."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    capitals = n - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    symbols = n - F.length(F.translate(text, "*&%$#!|<>{}=_~^", ""))
    # different words as a power of all words: near 1 in prose of any length
    richness = F.log(different + 1.0) / F.log(tokens + 1.5)
    level = lambda name, share, *at: F.concat(
        F.lit(f"{name}="), sum(((share >= x).cast("int") for x in at[1:]), (share >= at[0]).cast("int")).cast("string")
    )
    return F.array(
        level("capitals", capitals / n, 0.03, 0.1, 0.3),
        level("symbols", symbols / n, 0.005, 0.03, 0.1),
        level("richness", richness, 0.55, 0.65, 0.75, 0.85),
    )


def features(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, ``_tokens``, and ``_seen``: the given (or all) words it has, and its form."""
    split = docs.select("*", F.inline(F.array(F.struct(F.array_distinct(_words(F.col("text"))).alias("_words"), _tokens(F.col("text")).alias("_tokens")))))
    own = F.col("_words") if words is None else F.array_intersect("_words", F.lit(words).cast("array<string>"))
    form = _form(F.col("text"), F.size("_words"), F.col("_tokens"))
    seen = F.filter(own, lambda w: w != "")
    if words is not None:
        seen = F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit(QUIET)))
    return split.withColumn("_seen", F.concat(seen, form)).drop("_words")


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of at most ``SAMPLE`` labelled documents."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    named = labels.select(F.col("doc_id").cast("bigint"), domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL")
    one = named.groupBy("doc_id").agg(F.max("domain").alias("domain"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


def classifier(docs: DataFrame, labels: DataFrame) -> tuple[list[float], dict[str, list[float]]] | None:
    """Log prior odds of each domain with nothing seen, and what each word or form adds."""
    sample = docs.select(F.col("doc_id").cast("bigint"), "text").join(sized(as_table(labelled(labels), "sample")), "doc_id")
    seen = as_table(features(sample).select("domain", "_seen"), "seen")
    sizes = {r[0]: r[1] for r in seen.groupBy("domain").count().collect()}
    n = [sizes.get(k, 0) for k in range(len(DOMAINS))]
    total = sum(n)
    if not total:
        return None
    per = [F.count(F.when(F.col("domain") == k, 1)).alias(f"c{k}") for k in range(len(DOMAINS))]
    counted = seen.select("domain", F.explode("_seen").alias("word")).groupBy("word").agg(*per)
    all_of = sum((F.col(f"c{k}") for k in range(1, len(DOMAINS))), F.col("c0"))
    g = F.lit(0.0)
    for k, size in enumerate(n):
        for count, row in ((F.col(f"c{k}"), all_of), (size - F.col(f"c{k}"), total - all_of)):
            g = g + F.when(count > 0, count * F.log(count * total / (row * max(size, 1)))).otherwise(0.0)
    form = F.col("word").contains("=")
    lift = F.greatest(*(F.col(f"c{k}") * total / (all_of * max(size, 1)) for k, size in enumerate(n)))
    best = counted.withColumn("g", g).where((F.col("g") >= SURE) & (lift >= LIFT) | form)
    chosen = best.where(form).unionByName(best.where(~form).orderBy(F.desc("g"), "word").limit(WORDS)).collect()
    base = [math.log((size + 0.5) / (total + 1.5)) for size in n]
    words = F.lit([r["word"] for r in chosen if "=" not in r["word"]]).cast("array<string>")
    quiet = seen.where(~F.arrays_overlap("_seen", words)).groupBy("domain").count().collect()
    silent = {r[0]: r[1] for r in quiet}
    adds = {QUIET: [math.log((silent.get(k, 0) + 0.5) / (size + 1)) for k, size in enumerate(n)]} | {r["word"]: [math.log((r[f"c{k}"] + 0.5) / (size + 1)) for k, size in enumerate(n)] for r in chosen}
    return base, adds


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """All columns of ``docs``, ``_tokens`` and ``_p``, the posterior of each domain; None without labels."""
    fitted = classifier(docs, labels)
    if fitted is None:
        return None
    base, adds = fitted
    scored = features(docs, [w for w in adds if "=" not in w])
    known = F.create_map(*(x for w, v in adds.items() for x in (F.lit(w), F.array(*map(F.lit, v)))))
    none = F.array(*(F.lit(0.0) for _ in DOMAINS))
    score = F.aggregate(
        "_seen",
        F.array(*map(F.lit, base)),
        lambda a, w: F.zip_with(a, F.coalesce(F.element_at(known, w), none), lambda x, y: x + y),
    )
    scored = scored.select("*", F.inline(F.array(F.struct(score.alias("_score"))))).drop("_seen")
    odds = F.transform("_score", lambda x: F.exp(x - F.array_max("_score")))
    scored = scored.select("*", F.inline(F.array(F.struct(odds.alias("_odds"))))).drop("_score")
    whole = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)
    p = F.transform("_odds", lambda x: x / whole)
    return scored.select("*", F.inline(F.array(F.struct(p.alias("_p"))))).drop("_odds")


def cell(p: Column) -> Column:
    """Number of the posterior's cell."""
    number = F.lit(0)
    for k in range(len(DOMAINS) - 1):
        number = number * (STEPS + 1) + F.floor(p[k] * STEPS).cast("int")
    return number


def rates(cells: DataFrame, weights: dict[str, float], size: float) -> Column:
    """The fitted rate as an expression over the cell's mean posteriors ``p0, p1, ..``.

    ``cells`` has these and ``tokens``.
    """
    domains = range(len(DOMAINS))
    all_tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(max(all_tokens, 1)))
    target = [size * weights[d] for d in DOMAINS]
    # the norm of the posteriors' second moments bounds the step
    moments = cells.agg(*(F.sum(share * F.col(f"p{k}") * F.col(f"p{j}")) for k in domains for j in domains)).first()
    bound = max(sum(x * x for x in (m or 0.0 for m in moments)) ** 0.5, 1e-12)
    table = as_table(cells.withColumn("r", F.lit(1.0)).withColumn("y", F.lit(1.0)), "rates")
    t, last = 1.0, [math.inf] * len(target)
    for i in range(ITERATIONS):
        sums = table.agg(*(F.sum(share * F.col("y") * F.col(f"p{k}")) for k in domains)).first()
        miss = [(s or 0.0) - x for s, x in zip(sums, target, strict=True)]
        if max(map(abs, miss)) < TOLERANCE or max(abs(x - y) for x, y in zip(miss, last, strict=True)) < TOLERANCE / 10:
            break
        last = miss
        step = sum((F.col(f"p{k}") * F.lit(miss[k] / bound) for k in domains[1:]), F.col("p0") * F.lit(miss[0] / bound))
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        kept = [*cells.columns]
        moved = table.select(*kept, F.col("r").alias("old"), F.greatest(F.col("y") - step, F.lit(0.0)).alias("r"))
        table = moved.select(*kept, "r", F.greatest(F.col("r") + F.lit((before - 1) / t) * (F.col("r") - F.col("old")), F.lit(0.0)).alias("y"))
        if i % 10 == 9:
            table = as_table(table, "rates")
    return table


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, size: float = SIZE) -> DataFrame:
    """All columns of ``docs`` (with ``doc_id, text``) and ``p_good, p_poor, p_toxic, n_tokens, rate, copies``."""
    mine = [f"p_{d}" for d in DOMAINS] + ["n_tokens", "rate", "copies"]
    docs = docs.select(*(F.col(c) for c in docs.columns if c not in mine))
    # columns passed on travel as one, so that their names meet no name used here
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    passed = {c: F.col("_row")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")}
    scored = posteriors(docs.select("doc_id", "text", *([F.struct(*others).alias("_row")] if others else [])), labels)
    if scored is None:
        nothing = [F.lit(None).cast("double").alias(c) for c in mine[: len(DOMAINS)]]
        return docs.select("*", *nothing, _tokens(F.col("text")).alias("n_tokens"), F.lit(1.0).alias("rate"), F.lit(1).cast("bigint").alias("copies"))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # texts are read into words once; cells and copies come from what is written here
    scored = as_table(scored.select("*", cell(F.col("_p")).alias("_cell"), chance.alias("_chance")), "scored")
    sums = [F.sum(F.col("_tokens") * F.col("_p")[k]).alias(f"s{k}") for k in range(len(DOMAINS))]
    mean = [F.avg(F.col("_p")[k]).alias(f"m{k}") for k in range(len(DOMAINS))]
    cells = scored.groupBy("_cell").agg(F.sum("_tokens").alias("tokens"), *sums, *mean)
    p = [F.when(F.col("tokens") > 0, F.col(f"s{k}") / F.col("tokens")).otherwise(F.col(f"m{k}")).alias(f"p{k}") for k in range(len(DOMAINS))]
    table = rates(as_table(cells.select("_cell", "tokens", *p), "cells"), weights, size)
    # at most (STEPS + 1) * (STEPS + 2) / 2 rows
    out = scored.join(F.broadcast(as_table(table.select("_cell", F.col("r").alias("_rate")), "fitted")), "_cell")
    copies = F.floor("_rate") + (F.col("_chance") < F.col("_rate") - F.floor("_rate")).cast("bigint")
    return out.select(
        *(passed.get(c, F.col(c)) for c in docs.columns),
        *(F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)),
        F.col("_tokens").alias("n_tokens"),
        F.col("_rate").alias("rate"),
        copies.alias("copies"),
    )
