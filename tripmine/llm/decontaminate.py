"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside documents that may be thousands of times
longer. Documents fall into partitions by the power of two of their number of
shingles, items likewise. For each pair of partitions the hash space is cut into
so many buckets that an item contained at the threshold shares a bucket minimum
with the document except with probability ``miss``: the signature (one minimum
per bucket) grows with the partition's size bound, so containment is found in
long documents as surely as in short ones. Pairs found so are verified by the
exact share of the item's shingles that the document holds.

Documents are read once per block of items and nothing is shuffled. A block holds
at most about ``block_bytes`` of item text, so what is broadcast has a fixed bound;
more items mean more blocks, not larger ones.

Null, blank and empty texts (of either side) have no shingles and match nothing;
repeated rows of either side give repeated pairs; empty tables give no pairs.
Other columns of the inputs are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine.llm.shingles import common, rows_of, shingle_hashes

SCHEMA = "doc_id bigint, item_id bigint, n_item bigint, n_common bigint, containment double"


def buckets(n_doc: int, n_item: int, n_common: int, miss: float) -> int:
    """Buckets so that all of ``n_common`` shared shingles are hidden with probability ``miss`` at most.

    A shingle is hidden when another of the bucket is smaller; with on average
    ``x`` shingles per bucket that has probability below x / 2.
    """
    hidden = miss ** (1 / n_common)
    return min(1 << 31, math.ceil((n_doc + n_item) / (2 * hidden)))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """Smallest shingle of each non-empty bucket; ``shingles`` is sorted."""
    bucket = (shingles >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    first = np.ones(len(shingles), bool)
    first[1:] = bucket[1:] != bucket[:-1]
    return shingles[first]


class Items:
    """One block of items with their signatures for every document partition."""

    def __init__(self, rows: list[tuple[int, str | None]], k: int, threshold: float, miss: float):
        kept = [(i, s) for i, text in rows if len(s := shingle_hashes(text, k))]
        self.ids = [i for i, _ in kept]
        self.sets = [s for _, s in kept]
        self.threshold, self.miss = threshold, miss
        self.parts: dict[int, list[int]] = {}
        for at, s in enumerate(self.sets):
            self.parts.setdefault((len(s) - 1).bit_length(), []).append(at)
        self.signatures: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}

    def signature(self, part: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For documents of at most 2**part shingles: buckets, item minima sorted, their items."""
        if part not in self.signatures:
            out = []
            for item_part, members in self.parts.items():
                least = 1 if item_part == 0 else (1 << (item_part - 1)) + 1
                shared = max(1, math.ceil(self.threshold * least - 1e-9))
                n = buckets(1 << part, 1 << item_part, shared, self.miss)
                values = [minima(self.sets[m], n) for m in members]
                owners = np.repeat(np.array(members), [len(v) for v in values])
                flat = np.concatenate(values)
                order = np.argsort(flat, kind="stable")
                out.append((n, flat[order], owners[order]))
            self.signatures[part] = out
        return self.signatures[part]

    def within(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item id, size, shared shingles) of the items contained in a document."""
        part = (len(shingles) - 1).bit_length()
        found: set[int] = set()
        for n, values, owners in self.signature(part):
            own = minima(shingles, n)
            low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
            for i in np.flatnonzero(high > low):
                found.update(owners[low[i] : high[i]].tolist())
        for at in sorted(found):
            size = len(self.sets[at])
            if (shared := common(self.sets[at], shingles)) >= self.threshold * size - 1e-9:
                yield self.ids[at], size, shared


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    k: int = 5,
    miss: float = 1e-6,
    block_bytes: int = 8_000_000,
) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds the item.

    ``docs`` has ``doc_id, text``; ``items`` has ``item_id, text``.
    """
    items = items.select(F.col("item_id").cast("bigint"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(n_blocks))
    scanned = docs.select(F.col("doc_id").cast("bigint"), "text")
    context = docs.sparkSession.sparkContext
    out = None
    for b in range(n_blocks):
        held = context.broadcast([tuple(r) for r in items.where(block == b).collect()])
        found = scanned.mapInArrow(_search(held, k, threshold, miss), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def _search(held, k: int, threshold: float, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(held.value, k, threshold, miss)
        for batch in rows_of(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shingles = shingle_hashes(text.as_py(), k)
                if len(shingles):
                    rows += [(doc_id, i, n, c, c / n) for i, n, c in items.within(shingles)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "n_item", "n_common", "containment"],
            )

    return run
