"""Nearest neighbours and the pipeline, against brute force."""

import numpy as np

import corpus_pipeline
from graphcat.llm import curves

from . import brute


def test_hilbert_curve_steps_to_neighbours():
    points = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = curves.hilbert(points, 3)
    assert sorted(key) == list(range(512))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    m = centres[rng.integers(0, 12, 900)] + 0.3 * rng.standard_normal((900, 16))
    m[100:160] = 4 * m[100]  # long, so that it is nearest to itself
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(m)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (None, [1.0] * 16), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = curves.search(df, block=128).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    x = np.array([v for _, v in rows])
    assert set(by) == set(range(0, 900, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["id"]]) < 1e-9 for r in found)
        assert q not in {r["id"] for r in found}
        hits += len({r["id"] for r in found} & set(want))
    assert hits / (20 * len(by)) >= 0.9
    # of equal vectors, those with the smallest ids
    assert [r["id"] for r in by[120]] == list(range(100, 120))


def test_search_of_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["id"]) for r in curves.search(few).collect()}
    assert got == {(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)}
    assert curves.search(few.limit(0)).count() == 0


def test_stages(spark, docs, rows, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, rows[43][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    one = corpus_pipeline.language_id(spark, docs, folder)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept.isdisjoint({0, 1, 2, 3})
    two = corpus_pipeline.near_duplicates(spark, docs, folder)
    want = brute.components([(d, t) for d, t, *_ in rows])
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({i for i, _, c in want if i == c})
    assert two.columns == docs.columns
    three = corpus_pipeline.decontaminate(spark, docs, folder)
    assert three.columns == docs.columns and 43 not in {r["doc_id"] for r in three.collect()}
    four = corpus_pipeline.mix(spark, docs, folder)
    assert four.columns == docs.columns and four.count() > 0
    five = corpus_pipeline.shard(spark, docs, folder)
    assert five.count() == len(rows) and {"shard", "slot", "size"} <= set(five.columns)


def test_stages_on_nothing(spark, nothing, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
