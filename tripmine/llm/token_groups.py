"""N-gram Jaccard join over a token-group matrix, exact, up to connected components.

1. Texts with equal shingle sets are one *set*, so copies cost one row per task.
2. The tokens of the matrix are *cells*. A set that takes part in size class ``c``
   has its hash space cut into ``k + r`` blocks; a cell is the hash of all its
   shingles in one block. Two sets that link differ in at most ``k`` shingles, so
   at least ``r`` of their blocks are equal. Cells that one set alone has are dropped.
3. Similar sets are partitioned into groups: each goes with the most frequent of its
   cells, in parts of about ``GROUP`` members.
4. The matrix holds each group's cell union. A query set is counted against it: the
   number of its cells in the union bounds what it shares with any member, and only
   groups that reach the bound are opened.
5. In an opened group every pair is compared exactly, and only the edges that join
   two parts of the group's own forest leave it, so large families of near copies
   give rows in proportion to their members.

The smaller set of a pair is the query; sets enter the matrix for each class whose
members they can be the larger partner of. Empty cells are searched as well by those
few queries whose empty blocks alone could reach the bound, so no link is lost.

Sets are told apart by 64-bit hashes of their shingles' hashes. Null, blank and
empty texts have an empty set and link with nothing (also not with each other); a
repeated ``doc_id`` gives a row for each of its rows. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine.llm.graph import components
from tripmine.llm.ids import sized
from tripmine.llm.shingles import common, mixed, rows_of, shingle_hashes
from tripmine.workspace import as_table

#: Members of a group, and queries that one opening takes at a time.
GROUP, QUERIES = 128, 512
SETS = "doc_id bigint, mark bigint, n_shingles bigint, sid bigint, need int, class int"


@dataclass(frozen=True)
class Measure:
    """Shingle length and the threshold in hundredths."""

    words: int
    percent: int

    def linked(self, a: int, b: int, shared: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)

    def larger(self, a: int) -> int:
        """Size of the largest set that can link with one of ``a`` shingles."""
        return 100 * a // self.percent

    def differing(self, a: int) -> int:
        """Shingles that a set of at most ``a`` and a larger one may differ in."""
        p = self.percent
        return (100 - p) * (a + self.larger(a)) // (100 + p)

    def size_class(self, n: int) -> int:
        c = 0
        while bounds(c + 1) <= n:
            c += 1
        return c

    def classes(self, n: int) -> tuple[int, list[int]]:
        """The class of a set, and the lower ones it is a larger partner in."""
        own, lower = self.size_class(n), []
        while own - len(lower) > 0 and self.larger(bounds(own - len(lower)) - 1) >= n:
            lower.append(own - len(lower) - 1)
        return own, lower


@functools.cache
def bounds(c: int) -> int:
    """Least size of class ``c``: 1, 2, 3, 4, 6, 9, 13, ..."""
    return 1 if c == 0 else max(bounds(c - 1) + 1, bounds(c - 1) * 3 // 2)


def set_id(shingles: np.ndarray) -> int:
    total = mixed(np.array([mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))
    return int(total.view(np.int64)[0])


def cells(shingles: np.ndarray, c: int, measure: Measure) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells of a set in a class: of full blocks, of empty ones, and how many full ones a link needs.

    Where no two different sets of the class can link there are none.
    """
    k = measure.differing(bounds(c + 1) - 1)
    if k == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    equal = 8 + k // 4
    m = k + equal
    block = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    full = block[starts]
    sums = np.add.reduceat(mixed(shingles + np.uint64(17)), starts)
    empty = np.setdiff1d(np.arange(m, dtype=np.uint64), full)
    salt = np.uint64(c * 1_000_003 + 11)
    name = lambda at, what: mixed(what ^ mixed(at * np.uint64(2_654_435_761) + salt)).view(np.int64)
    return name(full, sums), name(empty, np.zeros(len(empty), np.uint64)), equal - len(empty)


def link_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``)."""
    measure = Measure(words, percent)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("mark"))
    sets = as_table(docs.mapInArrow(_scan_sets(measure), SETS), "sets")
    first = sets.where("n_shingles > 0").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "mark")).alias("at"), F.first("need").alias("need")
    )
    first = as_table(first, "first")
    links = _links(docs, sets, first, measure)
    found = components(links).select(F.col("id").alias("sid"), "component")
    # the smallest document of each component, found before copies are looked up
    named = first.join(found, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("sid", "component_id")
    out = sets.join(named, "sid", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _links(docs: DataFrame, sets: DataFrame, first: DataFrame, measure: Measure) -> DataFrame:
    # classes (at most 64) with a query whose empty blocks alone could reach the bound
    lonely = {r[0] for r in sets.where("need <= 0 AND n_shingles > 0").select("class").distinct().collect()}
    rows = docs.mapInArrow(_scan_cells(measure, lonely), "sid bigint, own array<bigint>, other array<bigint>")
    sides = F.array(
        F.struct(F.lit(True).alias("own"), F.col("own").alias("c")),
        F.struct(F.lit(False).alias("own"), F.col("other").alias("c")),
    )
    flat = rows.select("sid", F.inline(sides)).select("sid", "own", F.explode("c").alias("cell"))
    # one row per cell and set, then the cells that a query shares with another set
    per = "PARTITION BY cell"
    shared = as_table(
        flat.selectExpr(
            "*", f"min(sid) OVER ({per}) AS a", f"max(sid) OVER ({per}) AS b", f"max(own) OVER ({per}) AS asked"
        ).where("a < b AND asked").select("cell", "sid", "own"),
        "cells",
    )
    # a set goes with the most frequent of its cells, so a family falls into few groups
    often = shared.groupBy("cell").agg(F.count("*").alias("holders"))
    low = F.max(F.struct("holders", "cell"))["cell"].alias("low")
    active = shared.join(often, "cell").groupBy("sid").agg(low)
    active = as_table(active.join(first, "sid").select("sid", "low", "need"), "active")
    sizes = active.groupBy("low").agg(F.count("*").alias("members"))
    part = F.pmod(F.xxhash64("sid", F.lit(1)), F.ceil(F.col("members") / GROUP)).cast("int")
    groups = as_table(
        active.join(sizes, "low").select("sid", "need", F.xxhash64("low", part).alias("g")),
        "groups",
    )
    matrix = shared.join(groups.select("sid", "g"), "sid").groupBy("cell", "g").agg(
        F.min("sid").alias("one"), F.max("sid").alias("last")
    )
    asked = shared.where("own").select("cell", "sid").distinct()
    enough = asked.groupBy("sid").agg(F.count("*").alias("n")).join(groups.select("sid", "need"), "sid")
    asked = asked.join(enough.where("n >= need").select("sid"), "sid", "left_semi")
    # a group in which the query itself is the only holder of the cell has nothing to open
    met = asked.join(matrix, "cell").where("NOT (one = sid AND last = sid)")
    overlap = met.groupBy("sid", "g").agg(F.count("*").alias("n"))
    opened = overlap.join(groups.select("sid", "need"), "sid").where("n >= greatest(need, 1)")
    opened = as_table(opened.select("sid", "g"), "opened")
    return _open(docs, first, groups, opened, measure)


def _open(docs: DataFrame, first: DataFrame, groups: DataFrame, opened: DataFrame, measure: Measure) -> DataFrame:
    pieces = opened.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("pieces"))
    members = groups.select("sid", "g").join(pieces, "g").select(
        "sid", "g", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(False).alias("query")
    )
    asking = opened.join(pieces, "g").select(
        "sid", "g", F.pmod(F.xxhash64("sid", F.lit(2)), F.col("pieces")).cast("int").alias("piece"), F.lit(True).alias("query")
    )
    places = as_table(members.unionByName(asking), "places")
    held_in = first.select("sid", F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark"))
    wanted = sized(as_table(places.select("sid").distinct().join(held_in, "sid"), "wanted"))
    # one id may stand for several texts, and no id for many
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["mark"] == wanted["_mark"])).select("sid", "text")
    tokens = as_table(texts.mapInArrow(_tokens(measure.words), "sid bigint, tokens binary"), "tokens")
    tokens = tokens.groupBy("sid").agg(F.first("tokens").alias("tokens"))
    held = places.join(tokens, "sid")
    return as_table(
        held.groupBy("g", "piece").applyInPandas(_compare(measure), "a bigint, b bigint"), "links"
    )


def _scan_sets(measure: Measure):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["n_shingles", "sid", "need", "class"]

    def row(text: str | None) -> tuple:
        s = shingle_hashes(text, measure.words)
        if not len(s):
            return 0, None, None, None
        c = measure.size_class(len(s))
        return len(s), set_id(s), cells(s, c, measure)[2], c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            columns = list(zip(*(row(t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=["doc_id", "mark", *names])

    return run


def _scan_cells(measure: Measure, lonely: set[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # one entry per text of the task: copies send nothing
        for batch in rows_of(batches):
            ids, owns, others = [], [], []
            for text in batch.column(1):
                s = shingle_hashes(text.as_py(), measure.words)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                own, lower = measure.classes(len(s))
                full, empty, need = cells(s, own, measure)
                other = [np.zeros(0, np.int64)]
                if own in lonely:
                    full, other = (np.concatenate((full, empty)), other) if need <= 0 else (full, [empty])
                for c in lower:
                    more, empty, _ = cells(s, c, measure)
                    other += [more, empty] if c in lonely else [more]
                ids.append(sid)
                owns.append(full)
                others.append(np.concatenate(other))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), _lists(owns), _lists(others)], names=["sid", "own", "other"]
            )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [shingle_hashes(t.as_py(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["sid", "tokens"])

    return run


def _compare(measure: Measure):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asking = rows["query"].to_numpy(bool)
        ids = rows["sid"].to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        members = np.flatnonzero(~asking)
        sizes = np.array([len(sets[i]) for i in members])
        flat = np.concatenate([sets[i] for i in members])
        owners = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owners = flat[order], owners[order]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        edges = []
        for q in np.flatnonzero(asking):
            low, high = np.searchsorted(flat, sets[q]), np.searchsorted(flat, sets[q], "right")
            count = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            shared = np.bincount(owners[at], minlength=len(members))
            n = len(sets[q])
            for m in np.flatnonzero(100 * shared >= measure.percent * (n + sizes - shared)):
                a, b = int(ids[q]), int(ids[members[m]])
                if a != b and root(a) != root(b):
                    parent[root(a)] = root(b)
                    edges.append((a, b))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run
