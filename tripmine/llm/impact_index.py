"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are cut into shards and queries into blocks, both of bounded size; every
query meets every shard, as an exact answer over dense vectors demands. A posting is
one component of one vector; its impact (the integer component) is quantised to the
power of two below its magnitude. The postings of one quantised impact are a segment,
and a shard's segments are processed by falling impact, each for all queries of a
block still open at once (vectors are dense, so a segment is added by one matrix
product). After each segment the score of a vector is known up to the norm of the
query times the norm of what is left of the vector (Cauchy-Schwarz). A query stops
when all but a few vectors are proven to be below its k-th lower bound; the few are
scored exactly from their vectors. Shard results merge by a window per query.

Null vectors, and those with null or non-finite components, take no part, nor do
rows without an id; repeated ids are each a row of their own (and no answer to a
query of the same id); vectors of unlike length are compared within their length.
Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmine.workspace import as_table

SHARD, BLOCK = 8192, 8192
#: Queries that share a matrix product: 16 MB of scores.
TOGETHER = 256
ANSWER = "query_id bigint, vec_id bigint, score bigint"


class Index:
    """Postings of one shard by quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.values = vectors.astype(float)
        self.impact = np.frexp(self.values)[1]
        self.levels = np.unique(self.impact[vectors != 0])[::-1]
        self.norm = np.linalg.norm(self.values, axis=1)

    def possible(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Places of the vectors that may be among the k best, for each query."""
        n = len(self.ids)
        few = max(4 * k, n // 16)
        asked = queries.astype(float)
        size = np.linalg.norm(asked, axis=1)[:, None]
        # a query's own row never counts
        gained = np.where(own[:, None] == self.ids, -np.inf, 0.0)
        found = [np.flatnonzero(row == 0) for row in gained]
        still = np.flatnonzero([len(x) > few for x in found])
        gained = gained[still]
        for level in self.levels:
            if not len(still):
                break
            gained += asked[still] @ np.where(self.impact == level, self.values, 0.0).T
            rest = np.linalg.norm(np.where(self.impact < level, self.values, 0.0), axis=1)
            # the last term covers rounding of the products
            slack = size[still] * (rest + 1e-9 * self.norm)
            bar = np.partition(gained - slack, n - k, axis=1)[:, n - k]
            maybe = gained + slack >= bar[:, None]
            closed = (np.count_nonzero(maybe, axis=1) <= few) | (level == self.levels[-1])
            for i in np.flatnonzero(closed):
                found[still[i]] = np.flatnonzero(maybe[i])
            still, gained = still[~closed], gained[~closed]
        return found

    def top(self, own: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """Ids and scores of the k best vectors other than its own, for each query."""
        found = []
        for i in range(0, len(own), TOGETHER):
            part = slice(i, i + TOGETHER)
            for one, query, maybe in zip(own[part], queries[part], self.possible(own[part], queries[part], k), strict=True):
                score = self.vectors[maybe] @ query
                best = np.lexsort((self.ids[maybe], -score))[:k]
                found.append((np.full(len(best), one), self.ids[maybe][best], score[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def _search(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asking = rows["query"].to_numpy(bool)
        vectors = np.stack(rows["v"].to_numpy()).astype(np.int64)
        ids = rows["vec_id"].to_numpy()
        if asking.any() and not asking.all():
            return Index(ids[~asking], vectors[~asking]).top(ids[asking], vectors[asking], k)
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    return run


def quantised(table: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each valid vector."""
    x = F.col(vector)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.where(F.col("vec_id").isNotNull() & x.isNotNull() & sound)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return rows.select(F.col("vec_id").cast("bigint"), v.alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``; both inputs have ``vec_id, v``."""
    vectors = as_table(vectors, "vectors")
    queries = as_table(queries.dropDuplicates(["vec_id", "v"]), "queries")
    shards = max(1, -(-vectors.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    place = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select("vec_id", "v", place(1, shards).alias("shard"), over(blocks).alias("block"), F.lit(False).alias("query"))
    asked = queries.select("vec_id", "v", over(shards).alias("shard"), place(2, blocks).alias("block"), F.lit(True).alias("query"))
    rows = held.unionByName(asked).withColumn("length", F.size("v")).where("length > 0")
    found = rows.groupBy("shard", "block", "length").applyInPandas(_search(k), ANSWER)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
