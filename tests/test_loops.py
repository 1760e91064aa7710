"""Strong components, trimming and ring breaking: random graphs against plain
Python, and long graphs in few jobs."""

import random

import pytest
from pyspark.sql import functions as F

from graphcat.operators import components as C
from graphcat.operators import graph as G
from graphcat.operators import hierarchy as H

EDGES = "artifact_id string, source_id long, target_id long"


def _reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for s, t in edges:
            if s == todo[-1] and t not in seen:
                seen.add(t)
                todo.append(t)
                break
        else:
            todo.pop()
    return seen


def _plain_components(nodes, edges):
    ways = {n: _reach(edges, n) for n in nodes}
    return {n: min([n, *(m for m in nodes if m in ways[n] and n in ways[m])]) for n in nodes}


def _random_graphs(seed, n_graphs=8):
    """Sparse graphs with runs, rings, chords, loops and repeated edges."""
    rng = random.Random(seed)
    out = {}
    for g in range(n_graphs):
        n = rng.randint(2, 14)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, n + 4))]
        ring = rng.sample(range(n), rng.randint(1, n))
        edges += list(zip(ring, ring[1:] + ring[:1], strict=True)) if rng.random() < 0.5 else list(zip(ring, ring[1:], strict=False))
        out[f"g{g}"] = (range(n), edges + edges[:2])
    return out


def _frames(spark, graphs):
    nodes = spark.createDataFrame([(a, n) for a, (nodes, _) in graphs.items() for n in nodes], "artifact_id string, node_id long")
    return nodes, spark.createDataFrame([(a, s, t) for a, (_, edges) in graphs.items() for s, t in edges], EDGES)


@pytest.mark.parametrize("patience", [8, 0])
def test_components_of_random_graphs(spark, monkeypatch, patience):
    """With no patience, runs are contracted in each round."""
    monkeypatch.setattr(G, "PATIENCE", patience)
    graphs = _random_graphs(patience)
    got = {(r["artifact_id"], r["node_id"]): r["component"] for r in G.strongly_connected(*_frames(spark, graphs)).collect()}
    assert got == {(a, n): c for a, (nodes, edges) in graphs.items() for n, c in _plain_components(nodes, edges).items()}


@pytest.mark.parametrize("plain", [4, 1])
def test_edges_into_cycles(spark, monkeypatch, plain):
    """With plain 1, whole runs go in each round."""
    monkeypatch.setattr(G, "PLAIN", plain)
    graphs = _random_graphs(7 + plain)
    got = {(r["artifact_id"], r["source_id"], r["target_id"]) for r in G.in_cycles_or_before(_frames(spark, graphs)[1]).collect()}
    want = set()
    for a, (nodes, edges) in graphs.items():
        ways = {n: _reach(edges, n) for n in nodes}
        cyclic = {n for n in nodes if n in ways[n]}
        want |= {(a, s, t) for s, t in edges if t in cyclic or ways[t] & cyclic}
    assert got == want


def _jobs_of(spark, work):
    """Number of rounds' tables that are written to the checkpoint folder."""
    n, before = 0, G.settled

    def counted(df):
        nonlocal n
        n += 1
        return before(df)

    G.settled = counted
    try:
        return work(), n
    finally:
        G.settled = before


def test_long_chains_and_rings(spark):
    n = 3000
    chain = spark.range(n).select(F.lit("chain").alias("artifact_id"), F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))
    ring = spark.range(n).select(F.lit("ring").alias("artifact_id"), F.col("id").alias("source_id"), ((F.col("id") + 1) % n).alias("target_id"))
    # a ring with a chord, a way in and a way out
    more = spark.createDataFrame([("chord", 2000, 10), ("chord", n + 1, 0), ("chord", 7, n + 2)], EDGES)
    chord = ring.withColumn("artifact_id", F.lit("chord")).union(more)
    edges = chain.union(ring).union(chord)
    nodes = edges.select("artifact_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    got, jobs = _jobs_of(spark, lambda: G.strongly_connected(nodes, edges).collect())
    want = lambda a, v: v if a == "chain" or v > n else 0
    assert len(got) == 3 * n + 3
    assert all(r["component"] == want(r["artifact_id"], r["node_id"]) for r in got)
    assert jobs < 120
    # the chain alone goes as one run in each direction
    got, jobs = _jobs_of(spark, lambda: G.strongly_connected(nodes.filter("artifact_id = 'chain'"), chain).filter("component <> node_id").count())
    assert (got, jobs < 40) == (0, True)
    got, jobs = _jobs_of(spark, lambda: G.in_cycles_or_before(chain).count())
    assert (got, jobs < 30) == (0, True)


def _sequential(rows):
    """The rule as it is told: as long as there is a ring, the control created
    last on one loses what it requires within its component."""
    rows = set(rows)
    while True:
        edges = [(c, r) for c, r, _ in rows]
        component = _plain_components({x for e in edges for x in e}, edges)
        inner = [(t, c, r) for c, r, t in rows if component[c] == component[r]]
        if not inner:
            return {(c, r) for c, r, _ in rows}
        _, last, _ = max(inner)
        rows -= {(c, r, t) for c, r, t in rows if c == last and component[c] == component[r]}


def test_rings_broken_as_by_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = []
    for g in range(8):
        n = rng.randint(2, 6)
        made = [rng.randint(0, n) for _ in range(n)]  # some at one time
        rows += [(f"g{g}", *e) for e in {(c, rng.randrange(n), made[c]) for c in range(n) for _ in range(rng.randint(0, 3))}]
    p = spark.createDataFrame(rows, "artifact_id string, control_id long, req_control_id long, creation_ix int")
    got = {tuple(r) for r in C.break_prerequisite_cycles(p).select("artifact_id", "control_id", "req_control_id").collect()}
    want = {(a, c, r) for a in {row[0] for row in rows} for c, r in _sequential([row[1:] for row in rows if row[0] == a])}
    assert got == want
    assert C.break_prerequisite_cycles(p.limit(0)).count() == 0


def test_a_chain_of_rings(spark):
    """Four rings of three, each leading to the next: every ring's last control
    goes, and the ways between rings stay."""
    i = spark.range(4).withColumnRenamed("id", "i")
    edge = lambda s, t: F.struct(F.expr(s).alias("control_id"), F.expr(t).alias("req_control_id"))
    p = i.select(F.lit("a").alias("artifact_id"), F.explode(F.array(edge("3*i", "3*i+1"), edge("3*i+1", "3*i+2"), edge("3*i+2", "3*i"), edge("3*i", "3*i+3"))).alias("e")).select("artifact_id", "e.*", F.expr("e.control_id").alias("creation_ix")).filter("req_control_id < 12")
    left = C.break_prerequisite_cycles(p)
    assert {(r["control_id"], r["req_control_id"]) for r in p.exceptAll(left).collect()} == {(3 * k + 2, 3 * k) for k in range(4)}


def test_settled_leaves_no_shuffle_files(spark):
    """A loop's disk holds the shuffles of one round, and tables without void columns."""
    from pyspark.sql import functions as F

    from graphcat.fixpoint import WRITTEN, discard, settled

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.concat(F.lit("node:"), F.col("id")).alias("v"), F.lit(None).alias("none"))
    before = disk.getAllFiles().size()
    table = settled(rows.repartition(4, "k").groupBy("k", "none").agg(F.count("*").alias("n"), F.max("v").alias("v")))
    assert disk.getAllFiles().size() <= before
    assert table.columns == ["k", "none", "n", "v"] and dict(table.dtypes)["none"] == "void"
    assert table.agg(F.count("*"), F.sum("n"), F.max("v")).first()[:2] == (5000, 20_000)
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in table.inputFiles()}
    assert names <= WRITTEN
    discard(table)
    assert not names & WRITTEN


def test_partitions_grow_with_the_input(spark, tmp_path):
    from graphcat.plans import fixtures

    for name in fixtures.STAR:
        spark.range(10).write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "lineitem.parquet" / "part-x").write_bytes(b"x" * (10 * fixtures.PART_BYTES))
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        fixtures.deal_out(spark, str(tmp_path))
        assert int(spark.conf.get(names[0])) == 11
        assert all(fixtures._bytes(spark.conf.get(n)) <= fixtures.MOST_BYTES for n in names[1:])
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def _counted(spark, rows, schema):
    """A table, and how many of its rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def passed(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    return spark.createDataFrame(rows, schema).mapInPandas(passed, schema), made


def test_loops_make_their_edges_once(spark):
    edges, made = _counted(spark, [("a", i, i + 1) for i in range(6)], "artifact_id string, source_id long, target_id long")
    seed = spark.createDataFrame([("a", 0)], "artifact_id string, node_id long")
    assert {r.node_id for r in G.reachable(edges, seed).collect()} == set(range(7))
    assert made.value == 6


def test_routes_of_values_make_their_rules_once(spark):
    rows = [(i, "p", "forward", i + 1, "p", None) for i in range(4)] + [(4, "p", "render", None, None, None)]
    rules, made = _counted(spark, rows, "component long, prop string, kind string, to_component long, to_prop string, excluded array<string>")
    known = spark.createDataFrame([(i,) for i in range(5)], "component long")
    supplied = spark.createDataFrame([("v", 0, "p")], "value_id string, component long, prop string")
    ends = C.consumer_routes(supplied, rules, known)
    assert [tuple(r) for r in ends.collect()] == [("v", 4, "p")]
    assert made.value == 5


def test_overview_and_focus_make_their_edges_once(spark):
    groups = spark.createDataFrame([("d", g, g, None, False) for g in ("g", "h")], "artifact_id string, group_id string, title string, parent_group_id string, synthetic boolean")
    nodes = spark.createDataFrame([("d", "a", "g"), ("d", "b", "g"), ("d", "c", "h")], "artifact_id string, node_id string, group_id string")
    rows, schema = [("d", "e1", "a", "b"), ("d", "e2", "a", "c"), ("d", "e3", "c", "c")], "artifact_id string, edge_id string, source_node_id string, target_node_id string"
    edges, made = _counted(spark, rows, schema)
    assert [(r.source_id, r.target_id, r.n_edges) for r in H.overview_aggregates(groups, nodes, edges).collect()] == [("g", "h", 1)]
    assert made.value == 3
    edges, made = _counted(spark, rows, schema)
    focus = spark.createDataFrame([("d", "g")], "artifact_id string, focus_id string")
    told = {(r.edge_id, r.source_id, r.target_id, r.original) for r in H.focus_group(groups, nodes, edges, focus).collect()}
    assert told == {("e1", "a", "b", True), ("e2", "g", "h", False)}
    assert made.value == 3



def test_routes_make_their_rules_once(spark):
    from graphcat.operators import routes

    edges = spark.createDataFrame([("a", "e", "r", "x"), ("a", "f", "x", "y"), ("a", "g", "r", "y"), ("a", "h", "r", "y")], "artifact_id string, edge_id string, source_node_id string, target_node_id string")
    rows = [("a", "e", 0, "c", "1"), ("a", "f", 0, "c", "1"), ("a", "f", 1, "d", "2"), ("a", "h", 0, "c", "1"), ("a", "h", 0, "c", "2")]
    requirements, made = _counted(spark, rows, "artifact_id string, edge_id string, rule_ix int, control_id string, value string")
    node = lambda n: spark.createDataFrame([("a", n)], "artifact_id string, node_id string")
    found = {(tuple(r.path), tuple(tuple(q) for q in r.requirements)) for r in routes.ancestor_routes(edges, requirements, node("r"), node("y")).collect()}
    # h can't hold, g has no rules
    assert found == {(("e", "f"), (("c", "1"),)), (("e", "f"), (("c", "1"), ("d", "2"))), (("g",), ())}
    assert made.value == len(rows)



def test_a_set_of_requirements_is_completed_once(spark, monkeypatch):
    from graphcat.operators import routes

    candidates = spark.range(50).select(F.lit("a").alias("artifact_id"), F.col("id").alias("route"), F.array(F.struct(F.lit("c").alias("control_id"), F.lit("1").alias("value"))).alias("requirements"))
    needs = spark.createDataFrame([("a", "c", 0, "d", "2"), ("a", "c", 1, "e", "3")], "artifact_id string, control_id string, rule_ix int, req_control_id string, value string")
    rows, before = [], routes.settled

    def counted(df):
        out = before(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(routes, "settled", counted)
    got = {(r.route, tuple(tuple(q) for q in r.requirements)) for r in routes.with_prerequisites(candidates, needs).collect()}
    assert got == {(i, (("c", "1"), q)) for i in range(50) for q in (("d", "2"), ("e", "3"))}
    assert sum(n >= 50 for n in rows) == 1



def test_clicks_make_their_rules_once(spark):
    from graphcat.operators.selection import Gated

    edges = spark.createDataFrame([("a", "e", "r", "x")], "artifact_id string, edge_id string, source_node_id string, target_node_id string")
    requirements, made = _counted(spark, [("a", "e", 0, "c", "1")], "artifact_id string, edge_id string, rule_ix int, control_id string, value string")
    controls = spark.createDataFrame([("a", "c", "branch", "r")], "artifact_id string, control_id string, type string, owner_node_id string")
    needs = spark.createDataFrame([], "artifact_id string, control_id string, rule_ix int, req_control_id string, value string")
    graph = Gated(edges, requirements, controls, needs, spark.createDataFrame([("a", "r")], "artifact_id string, node_id string"))
    for value, nodes in (("1", {"r", "x"}), ("2", {"r"})):
        selected = spark.createDataFrame([("a", "s", "c", value)], "artifact_id string, scenario_id string, control_id string, value string")
        assert {r.node_id for r in graph.emphasis(selected)[0].collect()} == nodes
    assert made.value == 1



def test_few_keys_of_a_small_side_are_no_single_task(spark, tmp_path):
    """All elements of one artifact, and a table of artifacts whose size is not known."""
    from graphcat.operators import validate as V
    from graphcat.plans import fixtures

    for name in fixtures.STAR:
        spark.range(10).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin")
    before = {n: spark.conf.get(n) for n in names}
    try:
        fixtures.deal_out(spark, str(tmp_path))
        spark.conf.set(names[0], 16)
        elements = spark.range(5000).select(F.lit("dep").alias("artifact_id"), F.lit("edges").alias("element"), F.lit(0).alias("ordinal"), F.when(F.col("id") % 5 == 0, "message").otherwise("default").alias("type")).distinct().union(spark.range(1).select(F.lit("dep"), F.lit("nodes"), F.lit(1), F.lit("diamond")))
        artifacts = spark.createDataFrame([("dep", "dependency-graph")], "artifact_id string, layout_id string")
        found = V.element_type_contract(elements, artifacts)
        assert len(found.collect()) == 2
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)



def test_rules_are_multiplied_out_without_a_table_of_choices(spark, monkeypatch):
    from graphcat.operators import folding

    from .test_folding_and_contexts import CONDITIONS, ROWS, ruleset, table

    made = folding.fold_controls(spark.createDataFrame(ROWS, CONDITIONS), [(table(spark, rules := {("a", "e"): [[("k2", "on"), ("p1", "on")]], ("a", "f"): [[("k1", "off"), ("k2", "on")]]}), "edge_id")])
    written, before = [], folding.settled
    monkeypatch.setattr(folding, "settled", lambda df: written.append(df.columns) or before(df))
    new, never = made.rewritten(table(spark, rules), "edge_id")
    assert ruleset(new, "artifact_id", "edge_id") == {
        ("a", "e"): [[("k1", x), ("p1", "!open")] for x in ('"dark"', '"dim"', "otherwise")],
        ("a", "f"): [[("k1", x)] for x in ('"dim"', "otherwise")],
    }
    assert never.count() == 0
    assert len(written) == 2  # the requirements, and the rules made of them



def test_joined_partitions_of_a_shuffle_stay_small(spark, tmp_path):
    """32 partitions of 0.75 MB each, of which Spark makes fewer tasks."""
    from graphcat.plans import fixtures

    for name in fixtures.STAR:
        spark.range(10).write.parquet(f"{tmp_path}/{name}.parquet")
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names[1:]:
            spark.conf.unset(n)
        fixtures.deal_out(spark, str(tmp_path))
        spark.conf.set(names[0], 32)
        noise = F.concat(*(F.unhex(F.sha2(F.concat("id", F.lit(f" {i}")), 256)) for i in range(64)))
        parts = [r.p for r in spark.range(12 << 10).select("id", noise.alias("noise")).repartition("id").select(F.spark_partition_id().alias("p"), "noise").collect()]
        assert len(parts) == 12 << 10
        # 2 KB a row
        assert max(parts.count(p) for p in set(parts)) * 2048 <= 4.5 * 2**20
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def test_reached_nodes_are_not_sent_to_all_tasks(spark, monkeypatch):
    from graphcat import fixpoint
    from graphcat.operators import rulesets as R

    plans, before = [], fixpoint.settled
    monkeypatch.setattr(fixpoint, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df))
    table = lambda schema, *rows: spark.createDataFrame(rows, schema)
    needs = table("artifact_id string, control_id string, req_control_id string", ("a", "c", "d"), ("a", "e", "f"))
    controls = table("artifact_id string, control_id string, owner_node_id string", *(("a", c, "gone" if c == "g" else "r") for c in "cdefg"))
    needed = R.needed_controls(table("artifact_id string, control_id string", ("a", "c"), ("a", "g")), needs, controls, table("artifact_id string, node_id string", ("a", "r")))
    assert sorted(r.control_id for r in needed.collect()) == ["c", "d"]
    assert "SortMergeJoin" in needed._jdf.queryExecution().executedPlan().toString()
    assert all("SortMergeJoin" in p for p in plans[1:])


def test_small_files_of_many_rows_are_not_sent_to_all_tasks(spark):
    from pyspark.sql import functions as F

    from graphcat.fixpoint import settled

    made = settled(spark.range(1_000_000).select(F.concat(F.lit("cust:"), "id").alias("k"), F.lit(True).alias("known")))
    few = settled(spark.range(100).select(F.concat(F.lit("cust:"), "id").alias("k"), "id"))
    joined = lambda a, b: (settled(a.join(b, "k", "left")), spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription())
    wide, plan = joined(made.withColumnRenamed("known", "also"), made)
    assert wide.count() == 1_000_000 and "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" in joined(made, few)[1]


def test_routes_are_shuffled_once_a_round(spark, monkeypatch):
    from graphcat.operators import routes

    edges = spark.createDataFrame([("a", f"{s}{t}", s, t) for s, t in ("rx", "xy", "ry", "yz")], "artifact_id string, edge_id string, source_node_id string, target_node_id string")
    rules = [("a", "xy", 0, "c", "1"), ("a", "xy", 1, "d", "1"), ("a", "rx", 0, "c", "1"), ("a", "rx", 0, "d", "1")]
    rules = spark.createDataFrame([(a, e, k if e == "xy" else 0, c, v) for a, e, k, c, v in rules], "artifact_id string, edge_id string, rule_ix int, control_id string, value string")
    plans, before = [], routes.settled
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def told(df):
        if "seen" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return before(df)

    monkeypatch.setattr(routes, "settled", told)
    try:
        node = lambda n: spark.createDataFrame([("a", n)], "artifact_id string, node_id string")
        found = [(tuple(r.path), tuple(tuple(q) for q in r.requirements)) for r in routes.ancestor_routes(edges, rules, node("r"), node("z")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # two rules of one edge come to the same requirements
    assert sorted(found) == [(("rx", "xy", "yz"), (("c", "1"), ("d", "1"))), (("ry", "yz"), ())]
    # routes, roots and steps
    assert len(plans) > 2 and all(p.count("Exchange hashpartitioning") == 3 for p in plans[1:])


def test_module_graph_makes_its_candidates_once(spark):
    from graphcat.operators import modules as M

    rows = [("s", "a/f", "p", "import", "b/g", False, False, False, False, True), ("s", "a/f", "q", "import", "node_modules/q/i.js", False, False, False, True, False), ("s", "lost", "p", "import", "b/h", False, False, False, False, True)]
    candidates, made = _counted(spark, rows, "scope_id string, source string, specifier string, pass string, resolved string, could_not_resolve boolean, type_only boolean, core boolean, external boolean, boundary boolean")
    inventory = spark.createDataFrame([("s", "a/f"), ("s", "a/e")], "scope_id string, path string")
    manifests = spark.createDataFrame([("s", "b", "pack")], "scope_id string, directory string, name string")
    nodes = M.build_module_graph(candidates, inventory, manifests)[1]
    # what a file beyond the collection imports does not count
    assert {(r.node_id, r.outside) for r in nodes.collect()} == {("file:a/f", False), ("file:a/e", False), ("file:b/g", True), ("external:q", None)}
    assert made.value == len(rows)


def test_rewritten_rules_are_dealt_out_once(spark, monkeypatch):
    from graphcat.operators import folding

    from .test_folding_and_contexts import CONDITIONS, ROWS, table

    rules = {("a", "e"): [[("k2", "on"), ("p1", "on")]], ("a", "f"): [[("k1", "off"), ("k2", "on")]]}
    made = folding.fold_controls(spark.createDataFrame(ROWS, CONDITIONS), [(table(spark, rules), "edge_id")])
    plans, before = [], folding.settled
    monkeypatch.setattr(folding, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or before(df))
    made.rewritten(table(spark, rules), "edge_id")
    # subjects have a few rows, so requirements alone are dealt out, and literals of a subject gathered
    assert len(plans) == 2 and "REPARTITION_BY_COL" in plans[1]
    assert plans[1].count("Exchange hashpartitioning") <= 2


def test_visible_instances_are_joined_by_their_parent_only(spark):
    rows = [("1", None, "a", 0, [0]), ("2", "1", "h", 1, [0, 0]), ("3", "2", "h", 2, [0, 0, 0]), ("4", "3", "b", 3, [0, 0, 0, 0]), ("5", "1", "c", 1, [0, 1]), ("6", "3", "d", 3, [0, 0, 0, 1])]
    instances = spark.createDataFrame(rows, "instance_id string, parent_id string, definition_id string, depth int, way array<int>")
    shown = C.visible_instances(instances, spark.createDataFrame([("h",)], "definition_id string"))
    assert {(r.instance_id, r.parent_id, r.ordinal) for r in shown.collect()} == {("1", None, 0), ("4", "1", 0), ("6", "1", 1), ("5", "1", 2)}
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
