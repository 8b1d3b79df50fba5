"""Lexical search, passages and conversation tries against plain versions, also where work is cut small."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tripmine.llm import prefix_trie, presence_masks, suffix_groups

DOCS = "doc_id bigint, text string, mark string, n int, score string, spans string, first int"


def corpus(spark, rows):
    """Documents of (id, text), with other columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "m", 1, "s", "p", 2) for r in rows], DOCS)


def terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(docs, items, k=10):
    held = [(d, Counter(t), len(t)) for d, text in docs if (t := terms(text))]
    n, total = len(held), sum(size for _, _, size in held)
    out = []
    for item, text in dict.fromkeys(items):
        asked = Counter(terms(text))
        df = {t: sum(t in c for _, c, _ in held) for t in asked}
        scores = []
        for d, counts, size in held:
            m = 25 + 75 * size * n // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t, q in asked.items()
                if t in counts
            )
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def search_rows(rng, n):
    words = ["alpha", "Beta", "gamma", "d3lta", "É", "été", "the", "of", "漢字", "x_y", "a-b"]
    rows = [(i, " ".join(rng.choice(words[: rng.randrange(1, 12)]) for _ in range(rng.randrange(1, 40)))) for i in range(n)]
    return [*rows, (5, "alpha gamma"), (5, "alpha gamma"), (None, "alpha beta gamma"), (9000, None), (9001, ""), (9002, "\n-- !")]


@pytest.mark.parametrize(("block_bytes", "block_docs"), [(4_000_000, 16_384), (40, 16)])
def test_search_equals_plain_scores(spark, block_bytes, block_docs):
    rng = random.Random(11)
    docs = [*search_rows(rng, 300), (9003, "alpha " * 50_000)]
    items = [(1, "alpha Beta été"), (2, "the the of"), (3, None), (4, ""), (5, "nowhere"), (6, "x_y a-b 漢字 É"), (6, "gamma"),
             (7, " ".join(f"w{i}" for i in range(200)) + " alpha d3lta"), (None, "gamma"), (8, "gamma"), (8, "gamma")]
    table = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, rank int, doc_id int")
    found = presence_masks.search(corpus(spark, docs), table, block_bytes=block_bytes, block_docs=block_docs)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1], r[2] or 0)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(ranked(docs, items), key=key)


def test_search_stops_before_all_masks():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(12)
    rows = [sorted(rng.sample(range(40), rng.randrange(1, 6))) for _ in range(5000)]
    table = pa.table({"doc_id": range(5000), "n": [len(r) for r in rows], "terms": pa.array(rows, pa.list_(pa.int32())),
                      "tfs": pa.array([[1] * len(r) for r in rows], pa.list_(pa.int64()))})
    block, best = presence_masks.Block(table, 40, 5000, sum(map(len, rows))), presence_masks.Best(10)
    scored = presence_masks.search_block(block, np.arange(12), np.arange(1, 13) * 100, np.zeros(40, np.int64), best)
    whole = sorted(((-int(block.score(np.array([d]), np.concatenate((np.arange(1, 13) * 100, np.zeros(28, np.int64))))[0]), d) for d in range(5000)))
    assert [(-s, d) for s, d in zip(best.score.tolist(), best.doc.tolist())] == whole[:10] and scored < 1000


def test_search_of_nothing(spark):
    docs, items = corpus(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert presence_masks.search(docs.limit(0), items).collect() == []
    assert presence_masks.search(docs, items.limit(0)).collect() == []
    assert presence_masks.search(corpus(spark, [(1, None)]), items).collect() == []


def kept_words(docs, n):
    split = [(d, (text or "").encode().split()) for d, text in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - n + 1):
            if d is not None:
                x = tuple(w[i : i + n])
                first[x] = min(first.get(x, d), d)
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - n + 1) if d is not None and first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def passages(rng):
    shared = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(30)}" for _ in range(rng.randrange(12, 120))) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "same " * 300), (6, "same " * 200), (None, shared[0])]
    for i in range(120):
        parts = [f"{rng.choice('ijk')}{rng.randrange(40)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            text = rng.choice(shared).split()
            a = rng.randrange(len(text))
            parts += text[a:] if rng.random() < 0.5 else text
            parts += [f"Own{i}" if rng.random() < 0.5 else "Common"]
        rows.append((10 + i, rng.choice((" ", "\n", "\t \x0b")).join(parts)))
    rows += [(500, rows[20][1]), (500, rows[20][1]), (500, rows[21][1]), (501, "é\xa0è " * 100), (502, "é\xa0è " * 90)]
    return rows


@pytest.mark.parametrize(("words", "group", "tree_words"), [(50, 2000, 300_000), (12, 2000, 400), (12, 3, 400), (8, 2000, 300_000)])
def test_passages_equal_plain_windows(spark, words, group, tree_words):
    docs = passages(random.Random(13))
    found = suffix_groups.dedup_passages(corpus(spark, docs), words, group, tree_words)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == kept_words(docs, words)


def test_passages_of_long_texts_and_nothing(spark):
    rng = random.Random(14)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(700_000))
    rows = [(1, long[2_000_000:2_100_000]), (2, long)]
    found = suffix_groups.dedup_passages(corpus(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == kept_words(rows, 50)
    assert suffix_groups.dedup_passages(corpus(spark, rows[:0])).collect() == []


def test_suffix_tree_depths():
    import numpy as np

    rng = random.Random(15)
    for _ in range(50):
        tokens = [rng.randrange(3) for _ in range(60)] + [100]
        tree = suffix_groups.SuffixTree(np.array(tokens), np.arange(40), 16)
        order = tree.order.tolist()
        cut = [tokens[i : i + 16] for i in order]
        assert cut == sorted(cut)
        for a, b, common in zip(order, order[1:], tree.common.tolist(), strict=False):
            real = next(k for k in range(61) if tokens[a + k : a + k + 1] != tokens[b + k : b + k + 1])
            assert common == real or min(common, real) >= 16


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}
    members, text_of = {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, len(whole)))
            text_of[tuple(whole[:d])] = whole[d - 1][1] if d else ""
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        ends = ",".join(str(c) for c, size in sorted(held) if size == len(node))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        saved = sum((len(members[n]) - 1) * len(text_of[n]) for n in below)
        out.append((min(c for c, _ in held), len(node), parent, len(held), len(children), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(rng):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, None, None), (8, 0, "user", "ab"), (8, 0, "user", "c")]
    for c in list(range(100, 190)) + list(range(305, 330)):
        for t in range(rng.choice((1, 1, 2, 3, 7))):
            rows.append((c, t, rng.choice(("user", "assistant")), rng.choice(("hello", "hello", "yes", "é" * rng.randrange(3)))))
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(3)]
    return rows + [(2000, t, "user", f"t{t}") for t in range(2000)] + [(2001, t, "user", f"t{t}") for t in range(40)]


@pytest.mark.parametrize("chunk_turns", [200_000, 40, 1])
def test_trie_equals_plain_nodes(spark, chunk_turns):
    from pyspark.sql import functions as F

    rng = random.Random(16)
    rows = chats(rng) if chunk_turns != 1 else [r for r in chats(rng) if (r[0] or 0) < 2000]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, key int")
    convs = prefix_trie.conversations(table.repartition(5))
    convs = prefix_trie.with_donor_starts(
        convs, F.col("conv_id") - F.col("conv_id") % 100, (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"), 5
    )
    found = sorted((tuple(r) for r in prefix_trie.trie(convs, chunk_turns).collect()), key=repr)
    if chunk_turns == 1:
        assert found == plain_trie(rows)
    else:  # deep conversations: nodes of the plain version are compared by the path of one
        small = [r for r in rows if (r[0] or 0) < 2000]
        assert len(found) == len(set(found)) and len(found) >= 2000 - 5
        top = max(found, key=lambda r: r[1])
        assert top[1] == 2000 and top[3] == 1
        others = spark.createDataFrame([(*r, 1) for r in small], "conv_id bigint, turn bigint, role string, text string, key int")
        convs = prefix_trie.with_donor_starts(
            prefix_trie.conversations(others), F.col("conv_id") - F.col("conv_id") % 100,
            (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"), 5,
        )
        assert sorted((tuple(r) for r in prefix_trie.trie(convs, chunk_turns).collect()), key=repr) == plain_trie(small)


def test_trie_of_turnless_and_no_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    only = prefix_trie.conversations(spark.createDataFrame([(c, 0, "u", "t") for c in range(5)], schema))
    from pyspark.sql import functions as F

    bare = only.withColumn("turns", F.slice("turns", 1, 0))
    for size in (200_000, 1):
        rows = [tuple(r) for r in prefix_trie.trie(bare, size).collect()]
        assert rows == [(0, 0, None, 5, 0, 1, 0, hashlib.sha256(b"0,1,2,3,4").hexdigest())]
    assert prefix_trie.trie(only.limit(0)).collect() == []
