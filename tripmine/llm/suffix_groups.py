"""Removal of passages repeated across documents, by suffix trees over groups of suffixes.

A suffix counts if it has ``words`` words at least; its first ``words`` words are its
window. Suffixes are dealt out by a prefix whose length its own words decide: of the
window's runs of ``ANCHOR`` words the one of smallest hash (the leftmost) is the anchor,
and the prefix ends with it, after 8 to ``words`` words. Equal windows have equal
prefixes. All prefixes that end with one anchor go to one group.

1. *Stretches.* Neighbouring suffixes of one anchor form a stretch, about twenty of them,
   and a stretch is one row: anchor, digest of its words, place. Stretches of equal
   digest, the inside of all copies of a passage, meet in one row with the smallest
   document before anything else is done; partial sums take up copies in the tasks.
2. *Groups.* An anchor with a single stretch holds no other repeat. Of the others each
   different stretch's words are cut from the first document that has it, once.
3. *Trees.* A task takes the groups of its anchors, as many at a time as ``tree_words``
   allow, and builds their suffix tree as sorted suffixes and common prefixes (prefix
   doubling). Suffixes below one internal node of depth ``words`` or more repeat each
   other; the smallest document below the topmost such node is the window's first.
4. A group of over ``group`` different stretches does not go to one task. Its prefixes
   are made longer, to the whole window, where a group is one node of the tree and its
   smallest document is a sum with a partial step.
5. Each document gets the windows whose first document is smaller than itself.

``doc_id`` decides what is smaller; rows of one id do not take words from each other,
and a document without id neither takes nor loses words. A null text has no words. Equal
rows lose the same words. Texts are read whole, however long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine.llm.shingles import mixed, rows_of
from tripmine.workspace import as_table

WORDS, ANCHOR = 50, 8
#: Words of one tree inside a task, and different stretches of a group that goes to one task.
TREE_WORDS, GROUP = 300_000, 2_000
#: Windows of a text that are looked at together.
PIECE = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20260301).integers(0, 1 << 64, 256, np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class Text:
    """A text's words, joined by single spaces, with the place of each."""

    def __init__(self, text: bytes | None):
        words = (text or b"").split()
        self.n = len(words)
        self.joined = b" ".join(words)
        self.begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1)))

    def cut(self, first: int, n: int) -> bytes:
        return self.joined[self.begin[first] : self.begin[first + n] - 1]

    def run_hashes(self, first: int, n: int) -> np.ndarray:
        """Hashes of the ``n`` runs of ANCHOR words from word ``first`` on."""
        at = self.begin[first]
        data = np.frombuffer(self.joined, np.uint8)[at : self.begin[first + n + ANCHOR - 1] - 1]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[data] * _power(_BASE, len(data)), out=sums[1:])
        starts = self.begin[first : first + n] - at
        ends = self.begin[first + ANCHOR : first + ANCHOR + n] - 1 - at
        return mixed((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def stretches(text: Text, words: int) -> Iterator[tuple[int, int, int]]:
    """(first window, number of windows, anchor) of each stretch of a text."""
    windows, runs = text.n - words + 1, words - ANCHOR + 1
    for first in range(0, windows, PIECE):
        n = min(PIECE, windows - first)
        hashes = text.run_hashes(first, n + runs - 1)
        # the high bits order runs, the low ones tell their place
        least = hashes & ~np.uint64((1 << 20) - 1) | np.arange(len(hashes), dtype=np.uint64)
        size = 1
        while 2 * size <= runs:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[runs - size : runs - size + n])
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        sizes = np.diff(np.append(starts, n))
        yield from zip((starts + first).tolist(), sizes.tolist(), hashes[place[starts]].view(np.int64).tolist(), strict=True)


RUNS = "doc_id bigint, mark bigint, start int, n int, anchor bigint, digest binary"


def _stretches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = []
            for doc_id, mark, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = Text(data)
                if text.n >= words:
                    rows += [
                        (doc_id, mark, at, n, anchor, hashlib.md5(text.cut(at, n + words - 1)).digest())
                        for at, n, anchor in stretches(text, words)
                    ]
            yield _batch(rows, RUNS)

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


CUT = "anchor bigint, digest binary, first bigint, last bigint, n int, crowd bigint, words binary"


def _cut(words: int):
    """The words of wanted stretches from the texts they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = []
            for data, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = Text(data)
                rows += [
                    (w["anchor"], w["digest"], w["first"], w["last"], w["n"], w["crowd"], text.cut(w["start"], w["n"] + words - 1))
                    for w in wanted
                ]
            yield _batch(rows, CUT)

    return run


class SuffixTree:
    """Sorted suffixes of some texts and the common prefixes of neighbours, up to ``depth`` words and more.

    ``tokens`` are the texts' words as numbers, one after the other, each text closed by
    a number of its own; ``suffixes`` are the places that count.
    """

    def __init__(self, tokens: np.ndarray, suffixes: np.ndarray, depth: int):
        ranks, size = [tokens], 1
        while size < depth:
            last = ranks[-1]
            after = np.full(len(last), -1, np.int64)
            after[:-size] = last[size:]
            ranks.append(np.unique(last * (int(last.max()) + 2) + after + 1, return_inverse=True)[1])
            size *= 2
        self.order = suffixes[np.argsort(ranks[-1][suffixes], kind="stable")]
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        self.common = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero((a < len(tokens)) & (b < len(tokens)))
            same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
            self.common[same] += 2**level
            a[same] += 2**level
            b[same] += 2**level

    def topmost(self, depth: int) -> np.ndarray:
        """Where, in the order of suffixes, the topmost nodes of at least ``depth`` words begin."""
        return np.concatenate(([0], np.flatnonzero(self.common < depth) + 1))


FIRSTS = "digest binary, first bigint, last bigint, firsts array<bigint>"


def _tree_rows(group: pd.DataFrame, words: int) -> pa.RecordBatch:
    """For each stretch the first document of each of its windows."""
    group = group.drop_duplicates("digest")
    split = [w.split(b" ") for w in group["words"]]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    codes, names = pd.factorize(np.array([w for s in split for w in s], object))
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    tokens = np.empty(begin[-1], np.int64)
    closing = begin[1:] - 1
    is_word = np.ones(len(tokens), bool)
    is_word[closing] = False
    tokens[is_word] = codes
    tokens[closing] = len(names) + np.arange(len(split))
    windows = sizes - words + 1
    owner = np.repeat(np.arange(len(split)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    suffixes = begin[owner] + at
    tree = SuffixTree(tokens, suffixes, words)
    first = np.empty(len(tokens), np.int64)
    first[suffixes] = group["first"].to_numpy()[owner]
    nodes = tree.topmost(words)
    least = np.minimum.reduceat(first[tree.order], nodes)
    found = np.empty(len(tokens), np.int64)
    found[tree.order] = np.repeat(least, np.diff(np.append(nodes, len(tree.order))))
    found = np.split(found[suffixes], np.cumsum(windows)[:-1])
    rows = zip(group["digest"], group["first"].tolist(), group["last"].tolist(), found, strict=True)
    return _batch([(d, f, last, x) for d, f, last, x in rows if x.min() < last], FIRSTS)


def _trees(words: int, tree_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            table = batch.to_pandas()
            anchors = table["anchor"].to_numpy()
            cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            # rows of one anchor are neighbours; the last one may go on in the next batch
            for part in np.split(np.arange(len(table)), cuts):
                own = table.iloc[part]
                new_anchor = not held or held[-1]["anchor"].iat[-1] != own["anchor"].iat[0]
                if held and new_anchor and size > tree_words:
                    yield _tree_rows(pd.concat(held, ignore_index=True), words)
                    held, size = [], 0
                held.append(own)
                size += int((own["n"] + words).sum())
        if held:
            yield _tree_rows(pd.concat(held, ignore_index=True), words)

    return run


WINDOWS = "digest binary, first bigint, last bigint, place int, window binary"


def _windows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 400_000):
            rows = []
            for r in batch.to_pylist():
                text = Text(r["words"])
                rows += [
                    (r["digest"], r["first"], r["last"], i, hashlib.md5(text.cut(i, words)).digest()) for i in range(r["n"])
                ]
            yield _batch(rows, WINDOWS)

    return run


def _crowded(cut: DataFrame, words: int) -> DataFrame:
    """As the trees give it, for groups too large for one: each whole window is a group."""
    windows = as_table(cut.mapInArrow(_windows(words), WINDOWS), "windows")
    least = windows.groupBy("window").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    met = windows.join(least.where("n > 1").drop("n"), "window", "left")
    one = F.struct("place", F.coalesce("least", "first").alias("first"))
    found = met.groupBy("digest").agg(
        F.first("first").alias("first"), F.first("last").alias("last"), F.array_sort(F.collect_set(one)).alias("all")
    )
    found = found.select("digest", "first", "last", F.transform("all", lambda x: x["first"]).alias("firsts"))
    return found.where(F.array_min("firsts") < F.col("last"))


def first_documents(docs: DataFrame, runs: DataFrame, words: int, group: int, tree_words: int) -> DataFrame:
    """``digest, first, firsts``: per repeated stretch its first document, or that of each window."""
    place = F.min(F.struct("doc_id", "mark", "start", "n")).alias("at")
    found = runs.groupBy("digest").agg(F.min("anchor").alias("anchor"), place, F.max("doc_id").alias("last"))
    found = found.withColumn("first", F.col("at.doc_id"))
    crowds = found.groupBy("anchor").agg(
        F.count("*").alias("crowd"), F.min("first").alias("_least"), F.max("last").alias("_most")
    )
    crowds = crowds.where("crowd > 1 AND _least < _most").select("anchor", "crowd")
    found = found.join(crowds, "anchor", "left").where("crowd IS NOT NULL OR first < last")
    found = as_table(found, "stretches")
    asked = found.where("crowd IS NOT NULL").groupBy(F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark"))
    asked = asked.agg(F.collect_list(F.struct("anchor", "digest", "first", "last", "at.n", "crowd", "at.start")).alias("wanted"))
    texts = docs.join(asked, (F.col("doc_id") == F.col("_id")) & (F.col("mark") == F.col("_mark")))
    cut = as_table(texts.select(F.col("text").cast("binary"), "wanted").mapInArrow(_cut(words), CUT), "cut")
    near = cut.where(F.col("crowd") <= group).repartition("anchor").sortWithinPartitions("anchor")
    trees = near.mapInArrow(_trees(words, tree_words), FIRSTS)
    crowded = _crowded(cut.where(F.col("crowd") > group), words)
    alone = found.where("crowd IS NULL").select(
        "digest", "first", "last", F.lit(None).cast("array<bigint>").alias("firsts")
    )
    return alone.unionByName(trees).unionByName(crowded).select("digest", "first", "firsts")


def _kept(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            rows = []
            for doc_id, data, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = Text(data)
                if not spans:
                    rows.append((doc_id, text.n, 0, text.joined))
                    continue
                edge = np.zeros(text.n + 1, np.int64)
                for s in spans:
                    starts = [s["start"]] if s["gone"] is None else s["gone"]
                    length = s["n"] + words - 1 if s["gone"] is None else words
                    for at in starts:
                        edge[at] += 1
                        edge[at + length] -= 1
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                cuts = np.flatnonzero(np.diff(keep) > 1) + 1
                parts = [text.cut(int(p[0]), len(p)) for p in np.split(keep, cuts) if len(p)]
                rows.append((doc_id, text.n, text.n - len(keep), b" ".join(parts)))
            yield _batch(rows, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")

    return run


def dedup_passages(
    docs: DataFrame, words: int = WORDS, group: int = GROUP, tree_words: int = TREE_WORDS
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row of ``docs`` (with ``doc_id, text``).

    ``kept`` is the text without the words of windows that also start in a smaller
    document, its words joined by one space. ``words`` is 8 at least; ``group`` and
    ``tree_words`` bound what a task holds.
    """
    if words < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), "text")
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "mark", F.col("text").cast("binary").alias("text"))
    runs = as_table(named.mapInArrow(_stretches(words), RUNS), "runs")
    firsts = first_documents(docs, runs, words, group, tree_words)
    # rows come as stretches; a stretch of a third of all documents is split by the join
    met = runs.join(firsts, "digest").where(F.col("firsts").isNotNull() | (F.col("doc_id") > F.col("first")))
    windows = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("firsts", i) < F.col("doc_id"))
    gone = F.when(F.col("firsts").isNotNull(), F.transform(windows, lambda i: i + F.col("start")))
    spans = met.select("doc_id", "mark", F.struct("start", "n", gone.alias("gone")).alias("span"))
    spans = spans.where("span.gone IS NULL OR size(span.gone) > 0")
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("span").alias("spans"))
    same = (F.col("doc_id") == F.col("_id")) & (F.col("mark") == F.col("_mark"))
    whole = docs.join(spans, same, "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    kept = whole.mapInArrow(_kept(words), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
    return kept.withColumn("kept", F.col("kept").cast("string"))
