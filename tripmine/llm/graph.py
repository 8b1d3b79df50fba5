"""Connected components by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmine.workspace import as_table


#: Edges a task of a small table holds, and tasks that it has at least.
TASK_EDGES, TASKS = 50_000, 8


def components(edges: DataFrame, rounds: int | None = None, tasks: int | None = None) -> DataFrame:
    """``(id, component)`` of every end of an edge ``(a, b)``; the smallest id names a component.

    Each round hangs every vertex on the smallest one it can see; the number of
    rounds follows the logarithm of the longest chain. Rows of one vertex are
    never gathered: minima have a partial step and the joins may be split. Edges
    with a null end or from a vertex to itself are ignored. After a given number of
    ``rounds`` what is joined by then is given: parts of components, each vertex in one.
    ``tasks`` is how many tasks at most write the first tables, if that is known.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = edges.distinct()
    edges = as_table(edges.coalesce(tasks) if tasks else edges, "edges")
    before, done = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = small.unionByName(low.withColumnRenamed("m", "b")).distinct()
        if before is not None:
            # a round never adds edges: few of them need few files
            tasks = max(TASKS, before[0] // TASK_EDGES)
        new = new.coalesce(tasks) if tasks else new
        edges = as_table(new, "edges")
        state, done = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first(), done + 1
        if state == before or done == rounds:
            break
        before = state
    if rounds:
        # a vertex goes by what its smallest neighbour hangs on; that may hang on others itself
        edges = edges.groupBy("a").agg(F.min("b").alias("b"))
        ends = edges.select(F.col("a").alias("b"), F.col("b").alias("next"))
        hung = edges.join(ends, "b", "left").select("a", F.coalesce("next", "b").alias("b"), F.col("b").alias("near"))
        edges = as_table(hung.coalesce(tasks) if tasks else hung, "hung")
        roots = edges.select(F.explode(F.array("b", "near")).alias("id")).distinct().join(edges.select(F.col("a").alias("id")), "id", "left_anti")
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
