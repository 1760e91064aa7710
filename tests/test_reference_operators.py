"""Golden cases of the operators, and queries against their DuckDB twins."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphcat.functions import exprs as X
from graphcat.operators import components as C
from graphcat.operators import graph as G
from graphcat.operators import hierarchy as H
from graphcat.operators import rulesets as R
from graphcat.streaming import reviews

FOLDER = "/root/testdata/sf0.001"


def _one(spark, expression, **columns):
    return spark.range(1).select(expression).first()[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["overview_aggregates", "focus_group", "choose_dependency", "split_segments", "fragment_extents", "fold_annotation_log"])
def test_against_duckdb(spark, name):
    got = sorted(map(str, (tuple(r[c] for c in sorted(r.asDict())) for r in entry.queries()[name](spark, FOLDER).collect())))
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    r = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert len(got) == len(want := r.fetchall())
    as_number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    frame = entry.queries()[name](spark, FOLDER)
    ours = sorted(str(tuple(as_number(r[c]) for c in sorted(frame.columns))) for r in frame.collect())
    assert ours == sorted(str(tuple(as_number(r[i]) for i in order)) for r in want)


def test_long_chain_has_few_rounds(spark):
    chain = spark.range(3000).select(F.lit("a").alias("artifact_id"), F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    nodes = spark.range(3001).select(F.lit("a").alias("artifact_id"), F.col("id").alias("node_id"))
    ranks = G.longest_paths(nodes, chain)
    assert ranks.filter("rank <> node_id").count() == 0


def test_components_and_ranks(spark):
    edges = spark.createDataFrame([("a", s, t) for s, t in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 4)]], "artifact_id string, source_id long, target_id long")
    nodes = spark.createDataFrame([("a", n) for n in range(1, 8)], "artifact_id string, node_id long")
    got = {r["node_id"]: (r["component"], r["rank"]) for r in G.dependency_rank(nodes, edges).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 0)}


def test_rings_lose_the_latest_control(spark):
    p = spark.createDataFrame([("a", "x", "y", 1), ("a", "y", "z", 2), ("a", "z", "x", 3), ("a", "w", "x", 4)], "artifact_id string, control_id string, req_control_id string, creation_ix int")
    kept = {(r["control_id"], r["req_control_id"]) for r in C.break_prerequisite_cycles(p).collect()}
    assert kept == {("x", "y"), ("y", "z"), ("w", "x")}


def test_overview_has_ids_members_and_originals(spark):
    groups = [("d", "app", None), ("d", "pages", "app"), ("d", "api", None), ("d", "shared", None)]
    groups = spark.createDataFrame([(a, g, g, up, False) for a, g, up in groups], "artifact_id string, group_id string, title string, parent_group_id string, synthetic boolean")
    nodes = [("d", "app-a", "app"), ("d", "app-b", "app"), ("d", "page", "pages"), ("d", "api-file", "api"), ("d", "shared-file", "shared"), ("d", "root", None), ("plain", "a", None), ("plain", "b", None)]
    nodes = spark.createDataFrame(nodes, "artifact_id string, node_id string, group_id string")
    edges = [("app-a-to-api", "app-a", "api-file"), ("app-b-to-api", "app-b", "api-file"), ("page-to-api", "page", "api-file"), ("app-to-page", "app-a", "page"), ("app-to-app", "app-a", "app-b"), ('aggregate:["app","api"]', "api-file", "app-a"), ("root-to-api", "root", "api-file")]
    # two edges of the same ends, in a graph without groups
    edges = [("d", *e) for e in edges] + [("plain", "e1", "a", "b"), ("plain", "e2", "a", "b")]
    edges = spark.createDataFrame(edges, "artifact_id string, edge_id string, source_node_id string, target_node_id string")
    told = {(r.artifact_id, r.aggregate_id, r.source_id, r.target_id, r.n_edges, r.edge_id, r.original) for r in H.overview_aggregates(groups, nodes, edges).collect()}
    assert told == {("d", 'aggregate:["app","api"]:', "app", "api", 3, e, False) for e in ("app-a-to-api", "app-b-to-api", "page-to-api")} | {
        ("d", 'aggregate:["bundle:app","pages"]', "bundle:app", "pages", 1, "app-to-page", False),
        ("d", 'aggregate:["api","app"]', "api", "app", 1, 'aggregate:["app","api"]', False),
        ("d", 'aggregate:["root","api"]', "root", "api", 1, "root-to-api", False),
        ("plain", None, "a", "b", 1, "e1", True),
        ("plain", None, "a", "b", 1, "e2", True),
    }


def test_stored_graph_has_rulesets_and_auxiliary_definitions(spark):
    edges = spark.createDataFrame([("d", "e1"), ("d", "e2")], "artifact_id string, edge_id string")
    rules = [("d", "e2", 1, 0, "c", "on"), ("d", "e2", 0, 1, "c", "off"), ("d", "e2", 0, 0, "b", "x")]
    rules = spark.createDataFrame(rules, "artifact_id string, edge_id string, rule_ix int, req_ix int, control_id string, value string")
    suppliers = spark.createDataFrame([("d", "A", "Title A"), ("d", "B", None), ("d", "C", "Title C"), ("other", "C", None)], "artifact_id string, definition_id string, title string")
    nodes = spark.createDataFrame([("d", "C@0123456789abcdef")], "artifact_id string, node_id string")
    stored, auxiliary = C.to_stored_graph(edges, rules, suppliers, nodes)
    told = {r.edge_id: (r.type, r.active_when and [[tuple(q) for q in rule] for rule in r.active_when]) for r in stored.collect()}
    assert told == {"e1": ("default", None), "e2": ("control", [[("b", "x"), ("c", "off")], [("c", "on")]])}
    assert {tuple(r) for r in auxiliary.collect()} == {("d", "A", "Title A"), ("d", "B", "B"), ("other", "C", "C")}
    got = entry.queries()["to_stored_graph"](spark, FOLDER).groupBy("element", "type").count().collect()
    assert {(r[0], r[1]) for r in got} == {("edge", "control"), ("edge", "default"), ("auxiliary", None)}


def test_peeling_stops_at_loose_nodes_and_files(spark):
    groups = spark.createDataFrame([("a", "r", None, False), ("a", "s", "r", False), ("b", "r", None, False), ("b", "s", "r", False), ("c", "r", None, False), ("c", "x", None, True)], "artifact_id string, group_id string, parent_group_id string, synthetic boolean")
    nodes = spark.createDataFrame([("a", "n", "s"), ("b", "n", "s"), ("b", "m", None), ("c", "n", "r")], "artifact_id string, node_id string, group_id string")
    got = {(r["artifact_id"], r["group_id"]) for r in H.peel_root_shell(groups, nodes).collect()}
    # in a, r goes; s holds a node and stays
    assert got == {("a", "s"), ("b", "r"), ("b", "s"), ("c", "r"), ("c", "x")}


def test_ruleset_algebra(spark):
    rule = lambda *q: [{"control_id": c, "value": v} for c, v in q]
    df = spark.createDataFrame([([rule(("a", "1"))], [rule(("a", "2")), rule(("b", "1"))])], f"l {R.RULESET}, r {R.RULESET}")
    out = df.select(R.combine_rulesets(F.col("l"), F.col("r")).alias("c"), R.union_rulesets(F.col("l"), R.always()).alias("u"), R.union_rulesets(F.col("l"), F.col("l")).alias("s")).first()
    assert [[(q["control_id"], q["value"]) for q in r] for r in out["c"]] == [[("a", "1"), ("b", "1")]]
    assert out["u"] == [[]] and len(out["s"]) == 1


@pytest.mark.parametrize("label,negated,positive", [("a", "!a", "a"), ("!a", "a", "a"), ("!!a", "!a", "a"), ("a && b", "!(a && b)", "a && b"), ("!(a && b)", "a && b", "a && b"), ("(a) || (b)", "!((a) || (b))", "(a) || (b)")])
def test_labels(spark, label, negated, positive):
    assert _one(spark, X.negate_label(F.lit(label))) == negated
    assert _one(spark, X.positive_label(F.lit(label))) == positive


def test_review_updates(spark, tmp_path):
    schema = "scope_id string, seq long, status string, catalog string, annotations string"
    rows = [("s", 1, "valid", "a", None), ("s", 2, "valid", "a", None), ("s", 3, "valid", "b", None), ("s", 4, "invalid", "b", None), ("t", 5, "valid", "a", None), ("s", 6, "invalid", "b", None)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = reviews.review_updates(reviews.fingerprints(stream)).writeStream.format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["scope_id"], r["revision"], r["status"]) for r in spark.table("updates").collect())
    assert got == [("s", 1, "valid"), ("s", 2, "valid"), ("s", 3, "invalid"), ("t", 1, "valid")]
