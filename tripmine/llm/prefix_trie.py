"""The prefix trie of conversations from sorted sequences, without building a trie.

1. A turn is the digest of its role and text; a conversation is the array of its turns.
   Conversations are sorted by that array, then by id, over range partitions: copies of
   one conversation are told apart by id, so any number of them is cut where it must be.
2. A task goes through its stretch of the order in chunks. A sparse table over the
   lengths of common prefixes of neighbours answers range minima in two lookups; each
   candidate prefix, the first row ``i`` and depth ``d`` of a node, searches its left and
   right extent by doubling steps over that table, independently of all others. The
   interval gives members, smallest member, leaves and tokens from prefix sums.
3. A node whose interval does not touch an end of its chunk is complete. The others, the
   prefixes of a chunk's first and last row, are added up by key over all chunks. Where
   two chunks meet, what both counted is taken off again: the shared path is found from
   the last row of one and the first of the next, one pair per chunk.
4. A digest of members of a node in several chunks is taken over its pieces in order,
   as a stream.

A conversation is held by one task, as a document is. Turns are ordered by number (null
first), equal numbers by the digest of role and text; a null role or text is empty. Rows
without ``conv_id`` belong to no conversation and are left out. Repeated rows are turns
each. No conversation gives no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmine.workspace import as_table

#: Turns of one chunk inside a task (a longer conversation is a chunk of its own).
CHUNK_TURNS = 200_000
NODES = (
    "kind string, key binary, parent binary, depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, part int, chunk int, "
    "path array<binary>, chars array<bigint>"
)
NAMES = [x.split()[0] for x in NODES.split(", ")]
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` with ``turns`` an ordered array of (key, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.col("turn").cast("bigint")
    one = F.struct(turn.isNotNull().alias("given"), F.coalesce(turn, F.lit(0)).alias("turn"), key.alias("key"),
                   F.length(text).cast("bigint").alias("chars"))
    ordered = F.sort_array(F.collect_list(one))
    pair = lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))
    own = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("bigint").alias("conv_id"))
    return own.agg(F.transform(ordered, pair).alias("turns"))


def with_donor_starts(convs: DataFrame, donor: Column, kept: Column, most: int) -> DataFrame:
    """Each conversation's first ``kept`` turns (``most`` at most) exchanged for those of conversation ``donor``."""
    starts = convs.select(F.col("conv_id").alias("_donor"), F.slice("turns", 1, most).alias("_start"))
    both = convs.withColumns({"_of": donor, "_h": kept}).join(starts, F.col("_of") == F.col("_donor"), "left")
    given = F.coalesce("_start", F.slice("turns", 1, 0))
    rebuilt = F.concat(F.slice(given, F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.size("turns")))
    return both.select("conv_id", rebuilt.alias("turns"))


class RangeMinimum:
    """Sparse table: minima of all stretches whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of each stretch, both ends included."""
        out, sizes = np.empty(len(first), self.levels[0].dtype), np.frexp(last - first + 1)[1] - 1
        for j, table in enumerate(self.levels):
            at = np.flatnonzero(sizes == j)
            out[at] = np.minimum(table[first[at]], table[last[at] - 2**j + 1])
        return out

    def left(self, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first row reached from each row to the left while the values passed are at least ``least``."""
        at = rows.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            begin = at - 2**j + 1
            fits = np.flatnonzero(begin >= 1)
            fits = fits[self.levels[j][begin[fits]] >= least[fits]]
            at[fits] -= 2**j
        return at

    def right(self, rows: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last row reached to the right; the value of a row stands between it and the row before."""
        at = rows.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(at + 1 < len(self.levels[j]))
            fits = fits[self.levels[j][at[fits] + 1] >= least[fits]]
            at[fits] += 2**j
        return at


def _mix(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    x = (a * np.uint64(odd)) ^ (b + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Chunk:
    """Some conversations in sorted order: node keys, common prefixes, tokens."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, turn_keys: np.ndarray, chars: np.ndarray):
        n, self.conv, self.sizes = len(conv), conv, sizes
        # node (row, depth 0..size) is at begin[row] + depth
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        first_turn = self.begin[:-1] - np.arange(n)
        self.keys = np.zeros((self.begin[-1], 2), np.uint64)
        self.lcp = np.full(n, -1, np.int64)
        if n > 1:
            self.lcp[1:] = 0
        rows, alike = np.arange(n), np.arange(1, n)
        for d in range(1, int(sizes.max(initial=0)) + 1):
            rows = rows[sizes[rows] >= d]
            own, turn = self.begin[rows] + d, turn_keys[first_turn[rows] + d - 1]
            self.keys[own, 0] = _mix(self.keys[own - 1, 0], turn[:, 0], 0xD6E8FEB86659FD93)
            self.keys[own, 1] = _mix(self.keys[own - 1, 1], turn[:, 1], 0xA3B195354A39B70D)
            alike = alike[(sizes[alike] >= d) & (sizes[alike - 1] >= d)]
            alike = alike[(turn_keys[first_turn[alike] + d - 1] == turn_keys[first_turn[alike - 1] + d - 1]).all(axis=1)]
            self.lcp[alike] = d
        # tokens of the first d turns, at the node's place
        added = np.zeros(self.begin[-1], np.int64)
        is_turn = np.ones(self.begin[-1], bool)
        is_turn[self.begin[:-1]] = False
        added[is_turn] = chars
        self.chars = added
        total = np.cumsum(added)
        self.tokens = total - np.repeat(total[self.begin[:-1]], sizes + 1)

    def nodes(self) -> dict[str, np.ndarray]:
        """One entry per node of the chunk, by its first row, then depth."""
        n, lcp, sizes, begin = len(self.conv), self.lcp, self.sizes, self.begin
        new = sizes - lcp
        base = np.concatenate(([0], np.cumsum(new)))
        row = np.repeat(np.arange(n), new)
        depth = np.arange(base[-1]) - base[row] + lcp[row] + 1
        common, ids = RangeMinimum(lcp), RangeMinimum(self.conv)
        left, right = common.left(row, depth), common.right(row, depth)
        whole = self.tokens[begin[1:] - 1]
        met = np.where(lcp > 0, self.tokens[begin[:-1] + np.maximum(lcp, 0)], 0)
        sums = lambda x: np.concatenate(([0], np.cumsum(x)))
        between = lambda x: x[right + 1] - x[left]
        members = right - left + 1
        above = np.where(depth > 0, self.tokens[begin[row] + np.maximum(depth - 1, 0)], 0)
        each = between(sums(whole)) - members * above
        once = between(sums(whole - met)) - (above - met[row])
        following = np.concatenate((lcp[1:], [-1]))
        leaves = between(sums(following < sizes))
        # the parent begins at the same row, or where the common prefix with the row before does
        holder = common.left(row, np.maximum(depth - 1, 0))
        parent = base[holder] + depth - 1 - (lcp[holder] + 1)
        children = np.bincount(parent[depth > 0], minlength=len(row))
        smallest = ids.least(left, right)
        same = np.concatenate(([False], (lcp[1:] == sizes[1:]) & (sizes[1:] == sizes[:-1])))
        group_end = np.append(np.flatnonzero(~same), n)
        group = np.cumsum(~same) - 1
        ends_to = np.where(sizes[row] == depth, group_end[group[row] + 1], row)
        return {
            "row": row, "depth": depth, "left": left, "right": right, "n_convs": members, "conv_id": smallest,
            "n_children": children, "n_leaves": leaves, "saved_tokens": each - once, "ends_to": ends_to,
            "parent": parent, "parent_conv_id": smallest[parent], "key": begin[row] + depth,
        }

    def path(self, row: int) -> tuple[list[bytes], list[int]]:
        at = slice(self.begin[row], self.begin[row + 1])
        return [k.tobytes() for k in self.keys[at]], self.chars[at].tolist()


def _rows(chunk: Chunk, part: int, number: int) -> Iterator[pa.RecordBatch]:
    x, conv = chunk.nodes(), chunk.conv.tolist()
    opened = (x["left"] == 0) | (x["right"] == len(conv) - 1)
    ends = [",".join(map(str, conv[a:b])) if b > a else None for a, b in zip(x["row"].tolist(), x["ends_to"].tolist(), strict=True)]
    digests = [e if o else hashlib.sha256((e or "").encode()).hexdigest() for e, o in zip(ends, opened.tolist(), strict=True)]
    key_bytes = chunk.keys.tobytes()
    key = [key_bytes[16 * k : 16 * k + 16] for k in x["key"].tolist()]
    # a parent's node stands right before the child's in the child's row
    above = [key_bytes[16 * k - 16 : 16 * k] if d else None for k, d in zip(x["key"].tolist(), x["depth"].tolist(), strict=True)]
    kind = np.where(opened, "open", "closed").astype(object)
    # a complete node under an open one gets its parent's id later
    late = opened | opened[x["parent"]]
    rows = len(key)
    columns = [
        pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(above, pa.binary()),
        pa.array(x["depth"].astype(np.int32)), pa.array(x["conv_id"]), pa.array(x["parent_conv_id"], mask=late),
        *(pa.array(x[c].astype(np.int64)) for c in COUNTS), pa.array(digests, pa.string()),
        pa.array(np.full(rows, part, np.int32)), pa.array(np.full(rows, number, np.int32)),
        pa.nulls(rows, pa.list_(pa.binary())), pa.nulls(rows, pa.list_(pa.int64())),
    ]
    whole = pa.RecordBatch.from_arrays(columns, names=NAMES)
    for i in range(0, rows, 20_000):
        yield whole.slice(i, 20_000)
    paths = [chunk.path(0), chunk.path(len(conv) - 1)]
    blank = {
        "kind": pa.array(["first", "last"]), "part": pa.array([part] * 2, pa.int32()),
        "chunk": pa.array([number] * 2, pa.int32()), "path": pa.array([p for p, _ in paths], pa.list_(pa.binary())),
        "chars": pa.array([c for _, c in paths], pa.list_(pa.int64())),
    }
    yield pa.RecordBatch.from_arrays(
        [blank.get(f, pa.nulls(2, c.type)) for f, c in zip(NAMES, columns, strict=True)], names=NAMES
    )


def _chunk(batches: list[pa.RecordBatch]) -> Chunk:
    table = pa.Table.from_batches(batches)
    of = table.column("turns").combine_chunks()
    flat = of.flatten()
    digests = np.frombuffer(b"".join(flat.field("key").to_pylist()), np.uint64).reshape(-1, 2)
    sizes = of.value_lengths().to_numpy().astype(np.int64)
    return Chunk(table.column("conv_id").to_numpy(), sizes, digests, flat.field("chars").to_numpy(zero_copy_only=False))


def _chunks(most_turns: int):
    step = max(1, min(512, most_turns // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, turns = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                held.append(batch.slice(i, step))
                turns += len(held[-1].column("turns").flatten()) + held[-1].num_rows
                if turns >= most_turns:
                    yield from _rows(_chunk(held), part, number)
                    number, held, turns = number + 1, [], 0
        if held and turns:
            yield from _rows(_chunk(held), part, number)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, comma-joined; the pieces of a key come one after the other."""
    now, digest, out = None, None, []
    for batch in batches:
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if now is not None:
        out.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["key", "ends_sha256"]
    )


def _counted_twice(rows: DataFrame) -> DataFrame:
    """What neighbouring chunks both counted on the path they share, to be added to the open nodes."""
    ends = rows.where("kind IN ('first', 'last')").select("part", "chunk", "kind", "path", "chars")
    # two rows per chunk
    order = Window.orderBy("part", "chunk", "kind")
    pairs = ends.select(
        "kind", "path", "chars", F.lag("path").over(order).alias("before"), F.lag("chars").over(order).alias("tokens")
    ).where("kind = 'first' AND before IS NOT NULL")
    shared = F.filter(F.sequence(F.lit(0), F.least(F.size("path"), F.size("before")) - 1),
                      lambda d: F.get("path", d) == F.get("before", d))
    pairs = pairs.select("before", "tokens", F.size(shared).alias("n"))
    twice = pairs.select(
        F.posexplode(F.slice("before", F.lit(1), F.col("n"))).alias("depth", "key"),
        "n",
        F.slice("tokens", F.lit(1), F.col("n")).alias("tokens"),
        (F.col("n") == F.size("before")).alias("whole"),
    )
    tokens = F.aggregate(F.expr("slice(tokens, depth + 1, n - depth)"), F.lit(0).cast("bigint"), lambda s, t: s + t)
    return twice.select(
        "key",
        F.lit(None).cast("binary").alias("parent"),
        "depth",
        F.lit(None).cast("bigint").alias("conv_id"),
        F.lit(0).cast("bigint").alias("n_convs"),
        F.when(F.col("depth") + 1 < F.col("n"), -1).otherwise(0).cast("bigint").alias("n_children"),
        F.when(F.col("whole"), -1).otherwise(0).cast("bigint").alias("n_leaves"),
        tokens.alias("saved_tokens"),
    )


def trie(convs: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per node of the prefix trie over ``conv_id, turns`` (of :func:`conversations`).

    ``conv_id`` is the smallest member, ``ends_sha256`` the digest of the ids that end
    in the node, ascending and comma-joined.
    """
    keys = F.transform("turns", lambda t: t["key"])
    ordered = convs.withColumn("_keys", keys).repartitionByRange("_keys", "conv_id")
    ordered = ordered.sortWithinPartitions("_keys", "conv_id").select("conv_id", "turns")
    rows = as_table(ordered.mapInArrow(_chunks(chunk_turns), NODES), "nodes")
    opened = rows.where("kind = 'open'")
    pieces = opened.where("ends IS NOT NULL").select("key", F.col("ends").alias("piece"), "part", "chunk")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "piece")
    digests = pieces.mapInArrow(_digests, "key binary, ends_sha256 string")
    partial = opened.select("key", "parent", "depth", "conv_id", *COUNTS).unionByName(_counted_twice(rows))
    added = partial.groupBy("key", "depth").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in COUNTS)
    )
    added = as_table(added.join(digests, "key", "left"), "open")
    added = added.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    heads = added.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = ("conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256")
    merged = added.join(heads, "parent", "left").select(*out)
    closed = rows.where("kind = 'closed'").withColumnRenamed("ends", "ends_sha256")
    done = closed.where("parent_conv_id IS NOT NULL").select(*out)
    late = closed.where("parent_conv_id IS NULL").drop("parent_conv_id").join(heads, "parent").select(*out)
    whole = merged.unionByName(done).unionByName(late)
    return whole.withColumn("depth", F.col("depth").cast("bigint"))
