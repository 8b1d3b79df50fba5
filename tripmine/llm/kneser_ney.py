"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The units are UTF-16 code units of the text with white space runs as one space,
digits as 0, and a word right after itself as one mark, so that stutter costs as
much as foreign characters; four units fit a 64-bit key. Trusted text is all
documents labelled good and not toxic.

Counts come from every trusted document: each task counts its own text, partial
sums meet by key. Lower orders count distinct left neighbours, each order has three
discounts from its own counts of counts, and the probability of each n-gram seen is
joined from the next lower order. Tables of probabilities and back-off weights are
cut into shards by the last two context units; pairs and single units, which are few,
are in every shard. All that one position needs, seen or backed off, lies in one shard,
so documents meet the shards one by one and a document's sum is the sum over shards.
A shard has about ``SHARD`` rows beside the pairs, whatever the size of the corpus,
and is gone before the next one is sent.

A document's perplexity is shrunk to that of its language by ``PRIOR`` units, as
few characters say little. The threshold of a language lies ``REACH`` times as far
above the median of its trusted documents as their upper quantile does (in log
perplexity). Languages without trusted text, and null, use all trusted documents.

Null, blank and empty texts have a null perplexity and are not kept. Without any
trusted text there is no model: perplexities are null and all other documents are
kept. Repeated rows are scored and returned as often as they occur; ties at the
threshold are kept. Repeated or null label ids change nothing. Extra columns of
``docs`` are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine.llm.ids import sized
from tripmine.llm.shingles import rows_of
from tripmine.workspace import as_table

SHARD = 1_000_000
PRIOR = 60
QUANTILE, REACH = 0.99, 2.0
BIN = 0.002
BEGIN, END, REPEAT = 2, 3, "\x01"


def units(text: str) -> np.ndarray:
    """Code units of a text between three begin marks and an end mark."""
    words, last, out = text.split(), None, []
    for word in words:
        out.append(REPEAT if word == last else word)
        last = word
    own = np.frombuffer(" ".join(out).encode("utf-16-le", "surrogatepass"), np.uint16).copy()
    own[(own >= 48) & (own <= 57)] = 48
    own[(own == BEGIN) | (own == END)] = 4
    return np.concatenate(([BEGIN] * 3, own, [END])).astype(np.uint64)


def keys(stream: np.ndarray) -> np.ndarray:
    """Four units up to each position of concatenated texts."""
    a, b, c, d = (stream[i : len(stream) - 3 + i] for i in range(4))
    full = (a << np.uint64(48)) | (b << np.uint64(32)) | (c << np.uint64(16)) | d
    return full[d != BEGIN]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_keys, held_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in rows_of(batches, 500_000):
        texts = [units(t) for t in batch.column(0).to_pylist() if t and not t.isspace()]
        if not texts:
            continue
        new, counts = np.unique(keys(np.concatenate(texts)), return_counts=True)
        held_keys, back = np.unique(np.concatenate((held_keys, new)), return_inverse=True)
        held_counts = np.bincount(back, np.concatenate((held_counts, counts)), len(held_keys)).astype(np.int64)
        if len(held_keys) > 400_000:
            yield _counted(held_keys, held_counts)
            held_keys, held_counts = held_keys[:0], held_counts[:0]
    yield _counted(held_keys, held_counts)


def _counted(found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["k", "c"])


def counts(texts: DataFrame) -> DataFrame:
    """``k, c`` of every four units in the one text column."""
    return texts.mapInArrow(_count, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))


def _part(key: Column, first: int, n: int) -> Column:
    """``n`` units of a key, from unit ``first`` (0 is the last) on."""
    return F.shiftrightunsigned(key, 16 * first).bitwiseAND(F.lit((1 << 16 * n) - 1 if n < 4 else -1))


def _discounts(grams: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more."""
    row = grams.agg(*(F.count(F.when(F.col("c") == i, 1)) for i in range(1, 5))).first()
    n = [max(1, x) for x in row]
    y = n[0] / (n[0] + 2 * n[1])
    found = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def model(four: DataFrame) -> DataFrame:
    """``n, k, v, shard_unit``: log probability of n-grams (n = 1..4) and log back-off of contexts (n = -1..-3).

    ``k`` of an n-gram holds its n units; ``v`` of n = 0 is the log of the uniform probability.
    """
    by_order = {4: as_table(four, "grams4")}
    for n in (3, 2, 1):
        lower = by_order[n + 1].groupBy(_part(F.col("k"), 0, n).alias("k")).agg(F.count("*").alias("c"))
        by_order[n] = as_table(lower, f"grams{n}")
    uniform = 1 / (by_order[1].count() + 1)
    out, below = [], None
    for n in (1, 2, 3, 4):
        grams = by_order[n]
        d1, d2, d3 = _discounts(grams)
        discount = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        grams = grams.withColumn("ctx", F.shiftrightunsigned("k", 16)).withColumn("d", discount)
        contexts = grams.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
        joined = grams.join(contexts, "ctx")
        if n == 1:
            lower_p = F.lit(uniform)
        else:
            joined = joined.withColumn("low", _part(F.col("k"), 0, n - 1)).join(below, "low")
            lower_p = F.col("lower_p")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * lower_p
        probabilities = as_table(joined.select("k", p.alias("p")), f"p{n}")
        below = probabilities.select(F.col("k").alias("low"), F.col("p").alias("lower_p"))
        everywhere = F.lit(None).cast("bigint")
        unit = _part(F.col("k"), 1, 2) if n > 2 else everywhere
        out.append(probabilities.select(F.lit(n).alias("n"), "k", F.log("p").alias("v"), unit.alias("unit")))
        if n > 1:
            weight = contexts.select(F.lit(1 - n).alias("n"), F.col("ctx").alias("k"), F.log("weight").alias("v"))
            out.append(weight.withColumn("unit", _part(F.col("k"), 0, 2) if n > 2 else everywhere))
        else:
            weight = contexts.select(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.log(F.col("weight") * uniform).alias("v"))
            out.append(weight.withColumn("unit", everywhere))
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return as_table(table, "model")


class Shard:
    """Sorted tables of one shard, and the log probability of positions in it."""

    def __init__(self, rows: pa.Table, shard: int, shards: int):
        n, k, v = (rows.column(c).to_numpy() for c in ("n", "k", "v"))
        self.shard, self.shards, self.tables = shard, shards, {}
        for order in range(-3, 5):
            at = np.flatnonzero(n == order)
            at = at[np.argsort(k[at].view(np.uint64), kind="stable")]
            self.tables[order] = (k[at].view(np.uint64), v[at])

    def _look(self, order: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, values = self.tables[order]
        if not len(have):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        at = np.searchsorted(have, wanted)
        at[at == len(have)] = 0
        return have[at] == wanted, values[at]

    def log_probability(self, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which positions are of this shard, and their natural log probabilities."""
        mine = np.flatnonzero(in_shard((full >> np.uint64(16)) & np.uint64(0xFFFFFFFF), self.shards) == self.shard)
        todo, out = full[mine], np.zeros(len(mine))
        left = np.arange(len(mine))
        for n in (4, 3, 2, 1):
            wanted = todo[left] & np.uint64((1 << 16 * n) - 1)
            seen, value = self._look(n, wanted)
            out[left[seen]] += value[seen]
            left, wanted = left[~seen], wanted[~seen]
            if not len(left):
                break
            if n > 1:
                known, weight = self._look(1 - n, wanted >> np.uint64(16))
                out[left] += np.where(known, weight, 0.0)
            else:
                out[left] += self.tables[0][1][0]
        return mine, out


def in_shard(pair: np.ndarray, shards: int) -> np.ndarray:
    """Shard of two units packed into 32 bits; as :func:`_shard`."""
    low, high = pair & np.uint64(0xFFFF), pair >> np.uint64(16)
    return (low * np.uint64(40_503) + high * np.uint64(30_011)) % np.uint64(65_521) % np.uint64(shards)


def _shard(pair: Column, shards: int) -> Column:
    return (_part(pair, 0, 1) * 40_503 + _part(pair, 1, 1) * 30_011) % 65_521 % shards


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held.value
        for batch in rows_of(batches, 500_000):
            texts = [units(t or "") for t in batch.column(3).to_pylist()]
            if texts:
                full = keys(np.concatenate(texts))
                sizes = np.array([len(t) - 3 for t in texts])
                at, value = shard.log_probability(full)
                owner = np.repeat(np.arange(len(texts)), sizes)[at]
                sums = np.bincount(owner, value, len(texts)).astype(float)
                number = np.bincount(owner, minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(sums), pa.array(number)],
                    names=["doc_id", "mark", "lang", "s", "u"],
                )

    return run


def log_perplexity(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Per ``doc_id, mark, lang``: sum ``s`` of log probabilities and number ``u`` of units of the text."""
    shards = max(1, math.ceil(table.count() / SHARD))
    place = _shard(F.col("unit"), shards)
    schema = "doc_id bigint, mark bigint, lang string, s double, u bigint"
    texts, context, out = docs.select("doc_id", "mark", "lang", "text"), docs.sparkSession.sparkContext, None
    for i in range(shards):
        rows = table.where(F.col("unit").isNull() | (place == i)).select("n", "k", "v").toArrow()
        held = context.broadcast(Shard(rows, i, shards))
        part = as_table(texts.mapInArrow(_score(held), schema).withColumn("shard", F.lit(i)), "sums")
        held.destroy()
        out = part if out is None else out.unionByName(part)
    # equal rows have equal sums: one of them counts
    once = out.groupBy("doc_id", "mark", "lang", "shard").agg(F.min("s").alias("s"), F.min("u").alias("u"))
    return once.groupBy("doc_id", "mark", "lang").agg(F.sum("s").alias("s"), F.sum("u").alias("u"))


def _quantiles(scores: DataFrame, by: list[str]) -> DataFrame:
    """Exact median and upper quantile of binned ``-s / u``, from counts per bin."""
    bins = scores.groupBy(*by, F.round(-F.col("s") / F.col("u") / BIN).cast("bigint").alias("bin")).agg(F.count("*").alias("c"))
    table = bins.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("bins"), F.sum("c").alias("total"))

    def at(q: float) -> Column:
        begun = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("bin"))
        step = lambda s, b: F.struct(
            (s["seen"] + b["c"]).alias("seen"),
            F.coalesce(s["bin"], F.when(s["seen"] + b["c"] >= F.col("total") * q, b["bin"])).alias("bin"),
        )
        return F.aggregate("bins", begun, step, lambda s: s["bin"] * F.lit(BIN))

    return table.select(*by, at(0.5).alias("median"), at(QUANTILE).alias("upper"))


def marked(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``mark`` that tells different rows of one id apart."""
    return docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text", "lang").alias("mark"), "text", "lang"
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, mark, lang, trusted, perplexity, threshold, keep`` of each different row of ``docs``.

    ``docs`` has ``doc_id, text, lang``; ``labels`` has ``doc_id, quality, toxic``.
    """
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL")
    trusted = as_table(good.select(F.col("doc_id").cast("bigint")).distinct(), "trusted")
    texts = marked(docs)
    table = model(counts(texts.join(sized(trusted), "doc_id", "left_semi").select("text")))
    if not table.where("n = 4").take(1):
        nothing = F.lit(None).cast("double")
        return texts.select(
            "doc_id", "mark", "lang", F.lit(False).alias("trusted"), nothing.alias("perplexity"),
            nothing.alias("threshold"), F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("keep"),
        ).distinct()
    flag = sized(trusted.withColumn("labelled", F.lit(True)))
    scores = log_perplexity(texts, table).join(flag, "doc_id", "left")
    # a text without words has its end mark only
    scores = scores.withColumn("trusted", F.col("labelled").isNotNull() & (F.col("u") > 1))
    scores = as_table(scores.drop("labelled"), "scores")
    known = scores.where("trusted")
    by_lang = _quantiles(known.where("lang IS NOT NULL"), ["lang"])
    overall = _quantiles(known.withColumn("all", F.lit(1)), ["all"]).first()
    if overall is None:
        overall = {"median": None, "upper": None}
    middle = F.coalesce("median", F.lit(overall["median"]).cast("double"))
    upper = F.coalesce("upper", F.lit(overall["upper"]).cast("double"))
    score = (-F.col("s") + PRIOR * middle) / (F.col("u") + PRIOR)
    limit = middle + REACH * (upper - middle)
    some = F.col("u") > 1
    return scores.join(by_lang, "lang", "left").select(
        "doc_id",
        "mark",
        "lang",
        "trusted",
        F.when(some, F.exp(score)).alias("perplexity"),
        F.exp(limit).alias("threshold"),
        (some & (score <= limit)).alias("keep"),
    )


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    out = as_table(judged(docs, labels).where("NOT keep").select("doc_id", "mark"), "rejected")
    mark = F.xxhash64(docs["text"], docs["lang"])
    out = sized(out.select(F.col("doc_id").alias("_kn_id"), F.col("mark").alias("_kn_mark")))
    same = docs["doc_id"].cast("bigint").eqNullSafe(out["_kn_id"]) & (mark == out["_kn_mark"])
    return docs.join(out, same, "left_anti")
