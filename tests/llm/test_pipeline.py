"""The pipeline's stages against plain versions, and rows that share an id."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join(rng.choice(("river", "stone", "cloud", "paper", "green", "light")) + str(rng.randrange(60)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(7)
    items = [(i, prose(rng, 30)) for i in range(6)]
    rows = [(1, None), (2, ""), (3, "short text")]
    for i in range(60):
        rows.append((10 + i, "\n".join(prose(rng, 25) for _ in range(6))))
    rows += [(100 + i, rows[5 + i][1] + " more") for i in range(8)]
    rows += [(200 + i, f"{prose(rng, 60)} {items[i][1]} {prose(rng, 20)}") for i in range(6)]
    # one id, two texts: a copy and a clean one; benchmark and clean; and one row three times
    rows += [(300, rows[20][1] + " again"), (300, "\n".join(prose(rng, 25) for _ in range(3)))]
    rows += [(301, f"{prose(rng, 9)} {items[0][1]}"), (301, "\n".join(prose(rng, 25) for _ in range(3)))]
    rows += [(302, prose(rng, 90))] * 3
    rows += [(400 + i, "".join(chr(rng.randrange(0x100, 0x2FF)) for _ in range(300))) for i in range(4)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(10 + i, 1, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def read(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_quality_rejects_what_is_no_text(spark, given):
    folder, rows, _ = given
    kept = read(pipeline.quality(spark, table(spark, rows), folder))
    good = [(i, t) for i, t in rows if t and i < 400]
    assert set(kept) <= set(good) and len(kept) >= 0.9 * len(good)
    assert sum(i == 302 for i, _ in kept) == 3


def test_near_copies_equal_brute_force(spark, given):
    folder, rows, _ = given
    kept = read(pipeline.near_copies(spark, table(spark, rows), folder))
    distinct = list(dict.fromkeys(rows))
    of = {place: c for place, _, c in brute.linked_components([(p, t) for p, (_, t) in enumerate(distinct)], 5, 80)}
    first = {}
    for place, row in enumerate(distinct):
        first[of[place]] = min(first.get(of[place], row), row, key=lambda r: (r[0], r[1] or ""))
    expected = [r for p, r in enumerate(distinct) if not brute.words(r[1]) or first[of[p]] == r]
    assert [r for r in kept if r[1]] == sorted((r for r in expected if r[1]), key=repr)
    assert len(kept) == len(expected)
    assert [t for i, t in kept if i == 300] == [rows[-9 - 0][1]] or sum(i == 300 for i, _ in kept) == 1
    assert sum(i == 302 for i, _ in kept) == 1


def test_benchmark_rows_go_alone(spark, given):
    folder, rows, items = given
    kept = read(pipeline.without_benchmark(spark, table(spark, rows), folder))
    sets = [brute.word_shingles(t, 5) for _, t in items]
    clean = [(i, t) for i, t in rows if not any(10 * len(s & brute.word_shingles(t, 5)) >= 8 * len(s) for s in sets)]
    assert kept == sorted(clean, key=repr) and sum(i == 301 for i, _ in kept) == 1


def test_lines_equal_brute_force(spark, given):
    folder, rows, _ = given
    rows = list(dict(rows).items())
    found = pipeline.lines(spark, table(spark, rows), folder)
    assert {r.doc_id: r.text for r in found.collect()} == brute.kept_lines(rows)
    assert found.where(F.col("n_chars") != F.length("text")).count() == 0


def test_whole_pipeline(spark, given):
    folder, rows, _ = given
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    out = pipeline.run(spark, folder)
    assert out.columns[:5] == SCHEMA.replace(",", "").split()[::2] and "rate" in out.columns
    docs = table(spark, rows)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
    assert set(read(out)) <= set(read(docs)) and out.where("copies < 1").count() == 0
    ids = {r.doc_id for r in out.collect()}
    assert not ids & set(range(200, 206)) and not ids & set(range(400, 404)) and {300, 301, 302} <= ids
