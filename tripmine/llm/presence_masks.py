"""Ranked lexical search by presence masks.

A document's score for an item sums ``weight * impact`` over the item's terms, so
documents that hold the same of its terms differ by their impacts only. Three scans:

1. *Index*: one pass over the texts keeps, per document, its number of terms and the
   frequencies of the terms items ask for; document frequencies are counts over it.
2. *Masks*: a task takes its documents in blocks. In a block every term has the bitmap
   of the documents that hold it; for an item the bitmaps of its terms are laid over
   each other into one mask per document, and documents are grouped by mask.
3. *Search*: the highest score a mask allows is the sum, over its terms, of weight times
   the greatest impact in the block. Masks are scored exactly in descending order of
   that bound until it is below the score of the k-th best document so far, which the
   task carries from block to block. Each task returns k documents per item at most;
   their best are found in two steps, a few tasks' rows at a time.

Items are looked at by different text, in blocks of ``block_bytes`` of text (a single
longer text is a block of its own); the terms of one block are all that is ever sent to
the tasks, and documents are read once per block.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z is
lower-cased. Null and empty texts have no terms: such documents do not count, such items
have no result. Each row of ``docs`` is a document, also where ids repeat; a null id
comes last among equal scores. Equal item rows count once, rows of one ``item_id`` and
different texts are ranked each by itself. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmine.llm.shingles import rows_of
from tripmine.workspace import as_table

INDEX = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
FOUND = "item string, doc_id bigint, score bigint, task int"
#: Documents and postings of one block inside a task.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1_000_000

_LETTERS = bytes(
    c if c > 127 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32
    for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _index(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = held.value
        for batch in rows_of(batches):
            ids, sizes, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms_of(text) if text else ()
                if found:
                    counts = Counter(found)
                    asked = [t for t in counts if t in numbers]
                    ids.append(doc_id)
                    sizes.append(len(found))
                    terms.append([numbers[t] for t in asked])
                    tfs.append([counts[t] for t in asked])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = (ids, sizes, terms, tfs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"]
            )

    return run


class Block:
    """Documents of one block: postings by document and by term, with impacts."""

    def __init__(self, batch: pa.Table, n_terms: int, n_docs: int, total: int):
        self.null = batch.column("doc_id").is_null().to_numpy()
        self.ids = batch.column("doc_id").fill_null(0).to_numpy()
        size = batch.column("n").to_numpy()
        terms = batch.column("terms").combine_chunks()
        lengths = terms.value_lengths().to_numpy()
        self.begin = np.concatenate(([0], np.cumsum(lengths)))
        self.terms = terms.flatten().to_numpy().astype(np.int64)
        tf = batch.column("tfs").combine_chunks().flatten().to_numpy()
        m = 25 + 75 * size * n_docs // total
        owner = np.repeat(np.arange(len(size)), lengths)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])
        order = np.argsort(self.terms, kind="stable")
        self.holders = owner[order]
        self.from_term = np.searchsorted(self.terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.terms, self.impact)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold any of the terms, and their masks as rows of 64-bit words."""
        masks = np.zeros((len(self.ids), (len(terms) + 63) // 64), np.uint64)
        for i, t in enumerate(terms.tolist()):
            masks[self.holders[self.from_term[t] : self.from_term[t + 1]], i // 64] |= np.uint64(1 << i % 64)
        at = np.flatnonzero(masks.any(axis=1))
        return at, masks[at]

    def score(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores; each of ``docs`` holds a term at least."""
        sizes = self.begin[docs + 1] - self.begin[docs]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.arange(sizes.sum()) + np.repeat(self.begin[docs] - first, sizes)
        return np.add.reduceat(weight[self.terms[at]] * self.impact[at], first)


class Best:
    """The k best (score, document) so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        score, null, doc = (np.concatenate(x) for x in ((self.score, score), (self.null, null), (self.doc, doc)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.null, self.doc = score[order], null[order], doc[order]

    def closed_to(self, bound: int) -> bool:
        """No document of that score or less can come in; one as good as the last still may, by its id."""
        return bound <= 0 or len(self.score) == self.k and bound < self.score[-1]


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with a block's documents; returns how many were scored."""
    held = block.from_term[terms + 1] > block.from_term[terms]
    terms, weights = terms[held], weights[held]
    bounds = weights * block.most[terms]
    if not len(terms) or best.closed_to(int(bounds.sum())):
        return 0
    docs, masks = block.masks(terms)
    rows = np.ascontiguousarray(masks).view([("", np.uint64)] * masks.shape[1]).ravel()
    groups, of = np.unique(rows if masks.shape[1] > 1 else masks[:, 0], return_inverse=True)
    words = groups.view(np.uint64).reshape(len(groups), -1)
    most = np.zeros(len(groups), np.int64)
    for i, b in enumerate(bounds.tolist()):
        most += ((words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64) * b
    order = np.argsort(-most, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_mask = np.argsort(place[of], kind="stable")
    ends = np.cumsum(np.bincount(place[of], minlength=len(order)))
    dense[terms] = weights
    done, next_mask, take, scored = 0, 0, 4 * best.k, 0
    while next_mask < len(order) and not best.closed_to(int(most[order[next_mask]])):
        # masks of at least `take` documents, but none that the bar closes already
        stop = int(np.searchsorted(ends, done + take)) + 1
        if len(best.score) == best.k:
            stop = min(stop, int(np.searchsorted(-most[order], -best.score[-1], "right")))
        stop = max(min(stop, len(order)), next_mask + 1)
        chosen = docs[by_mask[done : ends[stop - 1]]]
        score = block.score(chosen, dense)
        some = score > 0
        best.add(score[some], block.null[chosen[some]], block.ids[chosen[some]])
        scored += len(chosen)
        done, next_mask, take = int(ends[stop - 1]), stop, 2 * take
    dense[terms] = 0
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[pa.Table]:
    held, docs, postings, step = [], 0, 0, min(1024, block_docs)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            held.append(part)
            docs += part.num_rows
            postings += len(part.column("terms").flatten())
            if docs >= block_docs or postings >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def _search(held, k: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items, weights, n_docs, total = held.value
        asked = [(key, np.array(t, np.int64), weights[t] * np.array(q, np.int64)) for key, t, q in items]
        best = {key: Best(k) for key, _, _ in asked}
        dense = np.zeros(len(weights), np.int64)
        for table in _blocks(batches, block_docs):
            block = Block(table, len(weights), n_docs, total)
            for key, terms, weight in asked:
                search_block(block, terms, weight, dense, best[key])
        found = [(key, b) for key, b in best.items() if len(b.score)]
        sizes = [len(b.score) for _, b in found]
        none = np.zeros(0, np.int64)
        docs = pa.array(
            np.concatenate([none, *(b.doc for _, b in found)]), mask=np.concatenate([none.astype(bool), *(b.null for _, b in found)])
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([key for key, _ in found], object), sizes), pa.string()),
                docs,
                pa.array(np.concatenate([none, *(b.score for _, b in found)])),
                pa.array(np.full(sum(sizes), TaskContext.get().partitionId()), pa.int32()),
            ],
            names=["item", "doc_id", "score", "task"],
        )

    return run


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_of_items(docs: DataFrame, texts: list[tuple[str, bytes]], k: int, block_docs: int) -> DataFrame | None:
    """``item, doc_id, score, task`` of the items' best documents, k per item and task; None without documents."""
    spark, counted = docs.sparkSession, [(key, Counter(terms_of(text))) for key, text in texts]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in counted))))}
    index = as_table(docs.mapInArrow(_index(spark.sparkContext.broadcast(numbers)), INDEX), "index")
    n_docs, total = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    weights = np.zeros(len(numbers), np.int64)
    for term, df in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    items = [(key, [numbers[t] for t in c], list(c.values())) for key, c in counted if c]
    held = spark.sparkContext.broadcast((items, weights, n_docs, total))
    return index.mapInArrow(_search(held, k, block_docs), FOUND)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 4_000_000, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    items = items.where("text IS NOT NULL").select(F.col("item_id").cast("bigint"), F.md5("text").alias("item"), "text").distinct()
    texts = as_table(items.groupBy("item").agg(F.first("text").cast("binary").alias("text")), "texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for b in range(blocks):
        of_block = texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        found = _block_of_items(docs, [(r.item, bytes(r.text)) for r in of_block.collect()], k, block_docs)
        if found is not None:
            out = found if out is None else out.unionAll(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], FOUND)
    few = _ranked(out.withColumn("some", F.col("task") % 64), k, "item", "some").drop("rank")
    best = _ranked(few, k, "item")
    return items.select("item_id", "item").join(best, "item").select("item_id", "rank", "doc_id", "score")
