"""Streams against their batch twins."""

import datetime
import random

from pyspark.sql import functions as F

from graphcat.operators import annotations
from graphcat.streaming import reviews


def run(spark, rows, schema, path, make, name, parts):
    """The rows, a file a trigger, through a stream; parts says how many files."""
    folder = str(path / name)
    for k in range(parts):
        spark.createDataFrame([r for i, r in enumerate(rows) if i * parts // len(rows) == k], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def test_fenced_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "scope_id string, seq long, kind string, operation_id string, revision_id string"
    rows = []
    for seq in range(60):
        kind = rng.choice(["start", "result", "result", "revision"])
        rows.append((rng.choice("ab"), seq, kind, None if kind == "revision" else rng.choice(["o1", "o2", "o3"]), f"r{seq // 9}"))
    want = {(r["scope_id"], r["seq"], r["operation_id"], r["revision_id"], r["applied"]) for r in annotations.fenced_results(spark.createDataFrame(rows, schema)).collect()}
    got = run(spark, rows, schema, tmp_path, reviews.fenced_updates, "fenced", 4)
    assert set(got) == want and len(got) == len(want)
    assert {r[4] for r in want} == {True, False}


def test_tries_of_bundles(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    c, a = "catalog", "annotations"
    rows = [
        ("match", 1, at(0), c, "r1"), ("match", 2, at(0), a, "r1"),
        ("late", 1, at(0), c, "r1"), ("late", 2, at(0), a, "r0"), ("late", 3, at(1), c, "r1"), ("never", 1, at(1), a, "r9"),
        ("fails", 1, at(1), c, "r2"), ("fails", 2, at(1), a, "r1"), ("fails", 3, at(1), c, "r3"), ("fails", 4, at(1), a, "r2"), ("fails", 5, at(1), c, "r4"), ("fails", 6, at(1), a, "r3"),
        ("missing", 1, at(2), c, "r5"), ("none", 1, at(2), c, None),
        ("late", 4, at(3), a, "r1"), ("fails", 7, at(3), c, "r4"), ("fails", 8, at(3), a, "r4"),
        ("clock", 1, at(40), c, None), ("clock", 2, at(59), c, None),
    ]
    schema = "scope_id string, seq long, read_at timestamp, kind string, revision_id string"
    got = run(spark, rows, schema, tmp_path, reviews.tried_bundles, "bundles", len(rows))
    fine = {(s, q, r, t) for s, q, r, t, error in got if error is None}
    assert fine == {("match", 2, "r1", 1), ("late", 4, "r1", 2), ("none", 1, None, 1), ("fails", 8, "r4", 1), ("clock", 1, None, 1), ("clock", 2, None, 1)}
    wrong = {(s, q, t) for s, q, _, t, error in got if error}
    assert wrong == {("fails", 6, 3), ("missing", 1, 1)}


def test_fingerprints_tell_contents_apart(spark):
    reads = [("s", 1, "ok", "a\nb", "c"), ("s", 2, "ok", "a", "b\nc"), ("s", 3, "ok", None, ""), ("s", 4, "ok", "", None), ("s", 5, "ok", "a", "b\nc")]
    df = spark.createDataFrame(reads, "scope_id string, seq long, status string, catalog string, annotations string")
    marks = {r["seq"]: r["fingerprint"] for r in reviews.fingerprints(df).collect()}
    assert len(set(marks.values())) == 4 and marks[2] == marks[5]


def test_spotlights(spark):
    schema = "artifact_id string, elements array<struct<type:string,id:string>>"
    walks = spark.createDataFrame([("a", [("node", "n1"), ("edge", "e1")]), ("a", [("node", "zz")]), ("b", []), ("c", [("node", "n1")]), ("a", None)], schema)
    artifacts = spark.createDataFrame([("a",), ("b",)], "artifact_id string")
    elements = spark.createDataFrame([("a", "node", "n1"), ("a", "edge", "e1"), ("c", "node", "n1")], "artifact_id string, type string, id string")
    got = [(r["artifact_id"], r["status"]) for r in reviews.spotlights(walks, artifacts, elements).collect()]
    assert sorted(got, key=str) == sorted([("a", 200), ("a", 422), ("b", 200), ("c", 404), ("a", 200)], key=str)
