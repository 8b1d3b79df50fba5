"""Fuzzy line dedup over the whole corpus.

1. A line is named by the hash of its trimmed text. Its signature is a MinHash of 40
   functions over all its 8-character shingles, whatever its length (a shorter line is one
   shingle); a band is four of them. Lines of similarity 0.8 share one of 10 bands with
   probability 0.995, of 0.9 with 0.99997; unlike lines (0.1) with 0.001, so candidates
   grow with the lines. A task signs a line once, where it first meets it, so copies
   cost a row and no signature.
2. Lines that share a band are a bucket; buckets are counted with a partial step, and those
   of the same lines are settled once. One of ``BUCKET`` lines at most is settled by one
   task, which compares every pair that its links so far do not join and gives the links
   that join parts of it. A larger one is dealt into chunks that are settled so, each
   together with the same ``LEADERS`` lines of the bucket. What all links of all buckets join is
   one part from then on: a bucket of one part is done, and lines of one part are compared
   no more. The pairs left in larger buckets are compared, by two blocks a task, if they are
   ``COMPARED`` for each line of the corpus at most; else the lines of open buckets are signed
   anew with more and longer bands (``LEVELS``), whose buckets hold fewer unlike lines and
   find a pair of 0.8 as surely. After the last level all that is left is compared. No task
   holds a large bucket.
3. Candidates are verified by the exact Jaccard similarity of their sets of all
   8-character shingles, at 0.8.
4. A distributed union-find over verified links gives components; the first line of
   each, by document, then position, is kept and all others are taken out.

Signing and verifying run in tasks over Arrow batches; all else is joins and aggregates.
SQL expressions alone take more CPU for enumerating and hashing all shingles than the
whole operator is allowed (see README for figures).

Lines are what newlines separate; blank lines are always kept and never compared.
A null text stays null, an empty one empty; a document all of whose lines go stays
with an empty text. Rows alike in id and text count as one document and keep the
same lines; a null id comes first. All columns of the input are passed on, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmine.llm.graph import components
from tripmine.llm.ids import sized
from tripmine.llm.shingles import mixed, rows_of
from tripmine.workspace import as_table

CHARS, SIMILARITY = 8, 0.8
#: Bands and functions of a band, by level: each finds a pair of 0.8 with probability 0.995 at least.
LEVELS = ((10, 4), (20, 6), (48, 9), (80, 12))
BANDS = LEVELS[0][0]
#: Lines of a bucket that one task settles, and leaders that those of a larger one are held against.
BUCKET, LEADERS = 128, 4
#: Pairs of open buckets that are compared at once, for each line of the corpus, instead of signing their lines anew.
COMPARED = 32
#: Lines for which a task is used, and tasks that there are at least: small tables are not cut into hundreds of files.
TASK_LINES, TASKS = 10_000, 8
#: Places that shingles are hashed to where more than a few lines are compared.
PLACES, FEW = 2048, 8
#: Lines a task remembers as signed, and characters it signs together.
KNOWN, SIGNED_CHARS = 200_000, 40_000

_PLACES = np.random.default_rng(20260901).integers(0, 1 << 31, CHARS, np.uint32) * np.uint32(2) + np.uint32(1)
_FACTORS = [
    np.random.default_rng(20260902 + level).integers(0, 1 << 31, b * r, np.uint32) * np.uint32(2) + np.uint32(1)
    for level, (b, r) in enumerate(LEVELS)
]


def signatures(lines: list[str], level: int = 0) -> np.ndarray:
    """Band values, one row per line."""
    lines = [line if len(line) >= CHARS else line.ljust(CHARS, "\0") for line in lines]
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    hashes = points[: len(points) - CHARS + 1] * _PLACES[0]
    for j in range(1, CHARS):
        hashes += points[j : len(points) - CHARS + 1 + j] * _PLACES[j]
    # shingles that run into the next line are none
    own = np.ones(len(hashes), bool)
    ends = np.cumsum(sizes)[:-1]
    own[(ends[:, None] - np.arange(1, CHARS)).ravel()] = False
    hashes = hashes[own]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        hashes ^= hashes >> np.uint32(shift)
        hashes *= np.uint32(factor)
    counts = sizes - CHARS + 1
    starts = np.cumsum(counts) - counts
    least = np.stack([np.minimum.reduceat(hashes * f, starts) for f in _FACTORS[level]], axis=1).astype(np.uint64)
    number, rows = LEVELS[level]
    bands = np.arange(number, dtype=np.uint64)
    for r in range(rows):
        bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows] + np.uint64(r + 1))
    return bands.view(np.int64)


LINES = "doc_id bigint, mark bigint, pos int, name bigint, bands array<bigint>"


def _signed(lines: list[str], level: int = 0) -> np.ndarray:
    """Signatures, computed for some lines at a time."""
    found, part, chars = [np.zeros((0, LEVELS[level][0]), np.int64)], [], 0
    for i, line in enumerate(lines):
        part.append(line)
        chars += len(line)
        if chars > SIGNED_CHARS or i == len(lines) - 1:
            found.append(signatures(part, level))
            part, chars = [], 0
    return np.concatenate(found)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: set[int] = set()
    for batch in rows_of(batches, 2_000_000):
        ids, marks, places, names, new = [], [], [], [], []
        for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for pos, line in enumerate(text.split(b"\n") if text else ()):
                line = line.strip(b" ")
                if line:
                    name = xxhash.xxh3_64_intdigest(line)
                    if name not in known:
                        known.add(name)
                        new.append((len(names), line.decode("utf-8", "replace")))
                    ids.append(doc_id)
                    marks.append(mark)
                    places.append(pos)
                    names.append(name)
        sizes = np.zeros(len(names) + 1, np.int32)
        sizes[[at + 1 for at, _ in new]] = BANDS
        found = _signed([line for _, line in new])
        bands = pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int32), found.ravel())
        columns = [
            pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int32()),
            pa.array(np.array(names, np.uint64).view(np.int64)), bands,
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in LINES.split(", ")])
        if len(known) > KNOWN:
            known.clear()


def signed_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, pos, name, bands`` of every line that is not blank; ``bands`` is
    empty where the task has given those of an equal line."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary"))
    return rows.mapInArrow(_sign, LINES)


def shingle_set(line: str) -> set[str]:
    return {line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1))}


def alike(a: set[str], b: set[str]) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
        return False
    common = len(a & b)
    return common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9


EDGES = "a bigint, b bigint"


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def may_be_alike(sets: list[set[str]]) -> np.ndarray:
    """Pairs that may be alike, by places of hashed shingles: a place that only one of two sets
    has is a shingle that only that one has, so no pair that is alike is left out."""
    held = np.zeros((len(sets), PLACES), np.float32)
    for row, shingles in zip(held, sets, strict=True):
        row[np.fromiter(map(hash, shingles), np.int64, len(shingles)) & (PLACES - 1)] = 1
    sizes = np.fromiter(map(len, sets), np.float64, len(sets))
    common = sizes[:, None] - (held.sum(axis=1)[:, None] - held @ held.T)
    common = np.minimum(common, common.T)
    return common >= SIMILARITY * (sizes[:, None] + sizes - common) - 1e-6


def family_links(lines: dict[int, str], parts: list[int] | None = None, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the parts of a bucket; every pair not joined yet is compared.

    Lines of one of ``parts`` are joined before; those of one side (other than 0) are compared elsewhere.
    """
    names, root = list(lines), np.array(parts or range(len(lines)), np.int64)
    if len(set(root.tolist())) < 2:
        return []
    side = np.array(sides or [0] * len(names))
    sets = [shingle_set(t) for t in lines.values()]
    open_ = (root[:, None] != root) & ((side[:, None] == 0) | (side[:, None] != side))
    if len(names) > FEW:
        open_ &= may_be_alike(sets)
    found = []
    for j, i in np.argwhere(np.tril(open_, -1)).tolist():
        if root[i] != root[j] and alike(sets[i], sets[j]):
            found.append((names[i], names[j]))
            root[root == root[j]] = root[i]
    return found


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket; its rows come one after the other."""
    now, held, found = None, {}, []

    def settled() -> list[tuple[int, int]]:
        return family_links({n: line for n, (line, _, _) in held.items()}, [p for _, p, _ in held.values()], [s for _, _, s in held.values()])

    for batch in batches:
        for key, name, line, part, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                found += settled()
                now, held = key, {}
            held[name] = line, part, side
        yield _edges(found)
        found = []
    yield _edges(settled())


def _resign(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1_000_000):
            bands = _signed(batch.column(1).to_pylist(), level)
            names = np.repeat(batch.column(0).to_numpy(), bands.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), pa.array(names)], names=["key", "name"])

    return run


def _tasks(lines: DataFrame) -> int:
    """How many tasks at most write what is derived from ``lines``."""
    return max(TASKS, lines.count() // TASK_LINES)


def _shared(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows ``key, name`` whose key several names have."""
    keys = rows.groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("most"))
    return rows.join(sized(as_table(keys.where("least < most").select("key").coalesce(tasks), "shared")), "key")


def _counted(rows: DataFrame, tasks: int, parts: DataFrame | None = None) -> DataFrame:
    """Different rows ``key, name, part`` of buckets of several parts, with the bucket's size ``n``.

    ``parts`` are the lines that links join so far; any other line is a part of its own.
    """
    led = rows.distinct()
    if parts is not None:
        led = _with_part(led, parts)
    else:
        led = led.withColumn("part", F.col("name"))
    led = as_table(led.coalesce(tasks), "led")
    sets = led.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("name")).alias("members"), F.min("part").alias("least"), F.max("part").alias("most")
    )
    once = sets.where("least < most").groupBy("n", "members").agg(F.min("key").alias("key")).select("key", "n")
    return as_table(led.join(sized(as_table(once.coalesce(tasks), "sets")), "key"), "counted")


def _with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with the part that each ``name`` is of; ``parts`` has ``id, component``."""
    parts = parts.select(F.col("id").alias("name"), "component")
    return rows.join(sized(parts), "name", "left").withColumn("part", F.coalesce("component", "name")).drop("component")


def _texts(docs: DataFrame, lines: DataFrame, names: DataFrame, tasks: int) -> DataFrame:
    """``name, line`` of the wanted names, from the first document that has the line."""
    names = sized(as_table(names.coalesce(tasks), "names"))
    first = lines.join(names, "name").groupBy("name").agg(F.min(F.struct("doc_id", "mark", "pos")).alias("at"))
    wanted = first.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark"))
    wanted = as_table(wanted.agg(F.collect_list(F.struct("at.pos", "name")).alias("wanted")).coalesce(tasks), "wanted")
    wanted = sized(wanted, 32 + 16 * F.size("wanted"))
    same = docs["doc_id"].eqNullSafe(wanted["_id"]) & (F.xxhash64(docs["text"]) == wanted["_mark"])
    held = docs.join(wanted, same).select(F.split("text", "\n", -1).alias("all"), F.explode("wanted").alias("x"))
    texts = held.select("x.name", F.trim(F.get("all", F.col("x.pos"))).alias("line"))
    return as_table(texts.dropDuplicates(["name"]).coalesce(tasks), "texts")


def _chunks(led: DataFrame, bucket: int) -> DataFrame:
    """Rows ``key, name, part, side``: buckets of ``bucket`` lines at most as they are; larger ones in
    chunks, to each of which the bucket's leaders are added."""
    here = ["key", "name", "part"]
    small = led.where(F.col("n") <= bucket).select(*here)
    big = led.where(F.col("n") > bucket).withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    place = F.pmod("name", F.lit(LEADERS))
    mine = big.select(F.xxhash64("key", F.pmod(F.xxhash64("name"), F.col("chunks"))).alias("key"), "name", "part")
    one = F.struct("name", "part")
    leaders = big.groupBy("key", "chunks").agg(*(F.min(F.when(place == i, one)).alias(f"l{i}") for i in range(LEADERS)))
    leaders = leaders.select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.array_compact(F.array(*(f"l{i}" for i in range(LEADERS)))).alias("l"))
    leaders = leaders.select(F.xxhash64("key", F.col("chunk").cast("bigint")).alias("key"), F.inline("l"))
    return small.unionByName(mine).unionByName(leaders).withColumn("side", F.lit(0))


def _blocks(rows: DataFrame, bucket: int, tasks: int) -> DataFrame:
    """Rows ``key, name, part, side``: any two lines of a bucket that are of different parts share a key.

    The lines of a bucket's largest part meet the other lines alone, in blocks of about ``bucket`` lines.
    """
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("lines"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("lines", "part")).alias("main"), F.sum("lines").alias("n"))
    sizes = as_table(sizes.select("key", "main.part", "main.lines", "n").coalesce(tasks), "sizes").withColumnRenamed("part", "main")

    def count(lines: Column) -> Column:
        return F.ceil(2 * lines / bucket).cast("int")

    rows = rows.select("key", "name", "part").join(sized(sizes), "key").withColumn("m", count(F.col("lines"))).withColumn("o", count(F.col("n") - F.col("lines")))
    inner = F.col("part") == F.col("main")
    rows = rows.withColumn("inner", inner).withColumn("mine", F.pmod(F.xxhash64("name"), F.when(inner, F.col("m")).otherwise(F.col("o"))).cast("int"))

    def key(kind: int, first: Column, second: Column) -> Column:
        return F.xxhash64("key", F.lit(kind), first, second).alias("key")

    def others(which: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(which) - 1)).alias("other")

    mine, other = F.col("mine"), F.col("other")
    at = ["key", "name", "part", "mine"]
    held = rows.where("inner").select(*at, others("o")).select(key(1, mine, other), "name", "part", F.lit(1).alias("side"))
    met = rows.where("not inner").select(*at, others("m")).select(key(1, other, mine), "name", "part", F.lit(2).alias("side"))
    rest = rows.where("not inner").select(*at, others("o"))
    side = F.when(mine == other, 0).when(mine < other, 1).otherwise(2).alias("side")
    rest = rest.select(key(2, F.least(mine, other), F.greatest(mine, other)), "name", "part", side)
    return held.unionByName(met).unionByName(rest)


def _settled(rows: DataFrame, texts: DataFrame, tasks: int) -> DataFrame:
    """Links ``a, b`` that join the parts of buckets ``key, name, part, side``."""
    rows = rows.join(texts, "name").select("key", "name", "line", "part", "side")
    return as_table(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets, EDGES).coalesce(tasks), "links")


def links(docs: DataFrame, lines: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Verified links ``a, b`` between names of lines."""
    tasks = _tasks(lines)
    led = _counted(_shared(lines.select(F.explode("bands").alias("key"), "name"), tasks), tasks)
    texts = _texts(docs, lines, led.select("name").distinct(), tasks)
    allowed = COMPARED * lines.count()
    found = None
    for level in range(1, len(LEVELS) + 1):
        edges = _settled(_chunks(led, bucket), texts, tasks)
        found = edges if found is None else found.unionByName(edges)
        big = led.where(F.col("n") > bucket).select("key", "name")
        if big.isEmpty():
            break
        parts = as_table(components(found, rounds=2, tasks=tasks).coalesce(tasks), "parts")
        big = as_table(_with_part(big, parts), "big")
        sizes = big.groupBy("key", "part").agg(F.count("*").alias("lines"))
        sizes = sizes.groupBy("key").agg(F.sum("lines").alias("n"), F.sum(F.col("lines") * F.col("lines")).alias("joined"))
        open_ = as_table(sizes.where("n * n > joined").select("key", ((F.col("n") * F.col("n") - F.col("joined")) / 2).alias("pairs")).coalesce(tasks), "open")
        pairs = open_.agg(F.sum("pairs")).first()[0]
        if not pairs:
            break
        big = big.join(sized(open_.select("key")), "key")
        if level == len(LEVELS) or pairs <= allowed:
            found = found.unionByName(_settled(_blocks(big, bucket, tasks), texts, tasks))
            break
        again = texts.join(big.select("name"), "name", "left_semi").select("name", "line")
        led = _counted(again.mapInArrow(_resign(level), "key bigint, name bigint"), tasks, parts)
    return found.distinct()


def dropped(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, gone``: positions of the lines to take out of each document that loses any."""
    lines = as_table(signed_lines(docs), "lines")
    tasks = _tasks(lines)
    joined = components(links(docs, lines), tasks=tasks)
    groups = as_table(joined.select(F.col("id").alias("name"), "component").coalesce(tasks), "groups")
    # lines that stand once and are like no other stay out of all that follows
    several = lines.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    several = several.join(sized(groups), "name", "left_anti").select("name", F.col("name").alias("component"))
    several = as_table(groups.unionByName(several).coalesce(tasks), "several")
    at = F.struct("doc_id", "mark", "pos")
    places = as_table(lines.join(sized(several), "name").select("component", at.alias("at")), "places")
    first = sized(as_table(places.groupBy("component").agg(F.min("at").alias("kept")).coalesce(tasks), "first"), 48)
    gone = places.join(first, "component").where(~F.col("at").eqNullSafe(F.col("kept"))).select("at.*")
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))


def _free(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that is not taken, in any case."""
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``doc_id, text``) without repeated lines; ``n_chars``, if there, is brought in line."""
    own = docs.select(F.col("doc_id").cast("bigint"), "text")
    gone = as_table(dropped(own), "gone")
    gone_id, mark, out, lines = (_free(n, docs.columns) for n in ("_gone_id", "_gone_mark", "_gone", "_lines"))
    gone = sized(gone.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(mark), F.col("gone").alias(out)), 32 + 4 * F.size(out))
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone[gone_id]) & (F.xxhash64(docs["text"]) == gone[mark])
    met = docs.join(gone, same, "left").withColumn(lines, F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    joined = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    changed = F.col(out).isNotNull()
    text = F.when(changed, joined).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(changed, F.length(text)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return met.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
