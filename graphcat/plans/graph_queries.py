"""Queries over the grouped dependency graph and the sparse directed graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import hierarchy as H
from ..operators import validate as V
from .catalog import EDGE_ID, dep_edges, one, query

DEP = ("dep_groups", "dep_nodes", "dep_edges")

# The peeled hierarchy: world goes, regions are roots.
_PEELED = """,
pg AS (SELECT group_id, CASE WHEN parent_group_id = 'world' THEN NULL ELSE parent_group_id END AS parent_group_id FROM dep_groups WHERE group_id <> 'world'),
anc AS (SELECT group_id, parent_group_id, [group_id] AS path FROM pg WHERE parent_group_id IS NULL
  UNION ALL SELECT p.group_id, p.parent_group_id, list_append(a.path, p.group_id) FROM pg p JOIN anc a ON p.parent_group_id = a.group_id),
np AS (SELECT node_id, n.group_id, coalesce(path, []) AS path FROM dep_nodes n LEFT JOIN anc a ON n.group_id = a.group_id),
"""
_SCOPED = (
    _PEELED
    + f"""
e0 AS (SELECT {EDGE_ID} AS edge_id, source_node_id, target_node_id, s.path AS sp, t.path AS tp FROM dep_edges JOIN np s ON s.node_id = source_node_id JOIN np t ON t.node_id = target_node_id),
e1 AS (SELECT *, CASE WHEN sp[1] IS NULL OR tp[1] IS NULL OR sp[1] <> tp[1] THEN 0 WHEN sp[2] IS NULL OR tp[2] IS NULL OR sp[2] <> tp[2] THEN 1 ELSE 2 END AS depth FROM e0),
sc AS (SELECT *, CASE WHEN depth > 0 THEN sp[depth] END AS scope, sp[depth + 1] AS sc_, tp[depth + 1] AS tc_ FROM e1),
mem AS (SELECT * FROM (SELECT edge_id, coalesce(sc_, CASE WHEN scope IS NOT NULL THEN 'bundle:' || scope ELSE source_node_id END) AS source_id,
  coalesce(tc_, CASE WHEN scope IS NOT NULL THEN 'bundle:' || scope ELSE target_node_id END) AS target_id FROM sc) m WHERE source_id <> target_id)
"""
)


def _dep(groups, nodes, edges):
    return one(groups), one(nodes), dep_edges(edges)


@query(*DEP, recursive=True, sql=_SCOPED + """
SELECT 'dep' AS artifact_id, 'aggregate:["' || source_id || '","' || target_id || '"]' AS aggregate_id, source_id, target_id, count(*) OVER (PARTITION BY source_id, target_id) AS n_edges,
  min(edge_id) OVER (PARTITION BY source_id, target_id) AS first_edge_id, edge_id, FALSE AS original FROM mem""")  # fmt: skip
def overview_aggregates(spark, groups, nodes, edges):
    return H.overview_aggregates(*_dep(groups, nodes, edges))


@query(*DEP, recursive=True, sql=_SCOPED + "SELECT 'dep' AS artifact_id, edge_id, source_id, target_id, FALSE AS original FROM mem")
def overview_members(spark, groups, nodes, edges):
    return H.overview_members(*_dep(groups, nodes, edges))


@query("dep_groups", recursive=True, sql=""",
anc AS (SELECT group_id, group_id AS path, 1 AS depth FROM dep_groups WHERE parent_group_id IS NULL
  UNION ALL SELECT p.group_id, a.path || '/' || p.group_id, a.depth + 1 FROM dep_groups p JOIN anc a ON p.parent_group_id = a.group_id)
SELECT group_id, path, depth FROM anc""")  # fmt: skip
def group_ancestors(spark, groups):
    return H.group_ancestors(one(groups)).select("group_id", F.array_join("path", "/").alias("path"), F.size("path").alias("depth"))


@query("dep_groups", "dep_nodes", sql="SELECT group_id, title, CASE WHEN parent_group_id = 'world' THEN NULL ELSE parent_group_id END AS parent_group_id FROM dep_groups WHERE group_id <> 'world'")
def peel_root_shell(spark, groups, nodes):
    return H.peel_root_shell(one(groups), one(nodes)).select("group_id", "title", "parent_group_id")


@query(*DEP, recursive=True, sql=_SCOPED + "SELECT edge_id, depth, scope, sc_ AS source_child, tc_ AS target_child FROM sc")
def lowest_common_scope(spark, groups, nodes, edges):
    g, n, e = _dep(groups, nodes, edges)
    paths = H.node_ancestors(n, H.group_ancestors(H.peel_root_shell(g, n)))
    return H.lowest_common_scope(e, paths).select("edge_id", "depth", "scope", "source_child", "target_child")


@query(*DEP, recursive=True, sql=_SCOPED + "SELECT DISTINCT scope, sc_ AS source_item, tc_ AS target_item FROM sc WHERE sc_ IS DISTINCT FROM tc_")
def scope_connections(spark, groups, nodes, edges):
    return H.scope_connections(*_dep(groups, nodes, edges)).select("scope", "source_item", "target_item")


@query(*DEP, sql=f"SELECT DISTINCT {EDGE_ID} AS edge_id FROM dep_edges WHERE source_node_id IN ('supplier:1', 'customer:7') OR target_node_id IN ('supplier:1', 'customer:7')")
def focus_node(spark, groups, nodes, edges):
    focus = spark.createDataFrame([("dep", "supplier:1"), ("dep", "customer:7")], "artifact_id string, node_id string")
    return H.focus_node(dep_edges(edges), focus).select("edge_id")


@query(*DEP, recursive=True, sql=_SCOPED + "SELECT edge_id FROM mem WHERE source_id = 'region:0' AND target_id = 'region:1'")
def focus_edges(spark, groups, nodes, edges):
    focus = spark.createDataFrame([("dep", "region:0", "region:1")], "artifact_id string, source_id string, target_id string")
    return H.focus_edges(H.overview_members(*_dep(groups, nodes, edges)), focus).select("edge_id")


@query(*DEP, recursive=True, sql=f""",
anc AS (SELECT group_id, [group_id] AS path FROM dep_groups WHERE parent_group_id IS NULL
  UNION ALL SELECT p.group_id, list_append(a.path, p.group_id) FROM dep_groups p JOIN anc a ON p.parent_group_id = a.group_id),
np AS (SELECT node_id, n.group_id, path FROM dep_nodes n LEFT JOIN anc a ON n.group_id = a.group_id),
f AS (SELECT group_id AS focus_id, parent_group_id AS focus_parent FROM dep_groups WHERE group_id IN ('region:2', 'nation:3')),
x AS (SELECT focus_id, focus_parent, {EDGE_ID} AS edge_id, source_node_id AS s, target_node_id AS t, a.group_id AS sg, b.group_id AS tg,
  list_contains(a.path, focus_id) AS si, list_contains(b.path, focus_id) AS ti
  FROM dep_edges JOIN np a ON a.node_id = source_node_id JOIN np b ON b.node_id = target_node_id CROSS JOIN f)
SELECT focus_id, edge_id, si AND ti AS original,
  CASE WHEN si AND ti THEN s WHEN si THEN focus_id WHEN sg IS NOT DISTINCT FROM focus_parent THEN s ELSE coalesce(sg, s) END AS source_id,
  CASE WHEN si AND ti THEN t WHEN ti THEN focus_id WHEN tg IS NOT DISTINCT FROM focus_parent THEN t ELSE coalesce(tg, t) END AS target_id
FROM x WHERE si OR ti""")  # fmt: skip
def focus_group(spark, groups, nodes, edges):
    focus = spark.createDataFrame([("dep", "region:2"), ("dep", "nation:3")], "artifact_id string, focus_id string")
    return H.focus_group(*_dep(groups, nodes, edges), focus).drop("artifact_id")


@query("dep_groups", "dep_nodes", sql="SELECT group_id, 'bundle:' || group_id || CASE WHEN group_id = 'nation:1' THEN ':' ELSE '' END AS bundle_id FROM dep_groups")
def bundle_ids(spark, groups, nodes):
    reserved = one(groups).select("artifact_id", F.concat(F.lit("bundle:"), "group_id").alias("id")).filter("id = 'bundle:nation:1'").union(one(nodes).select("artifact_id", "node_id"))
    return H.bundle_ids(one(groups), reserved).select("group_id", "bundle_id")


@query("dep_edges", sql=f"SELECT node_id, count(*) AS n FROM (SELECT source_node_id AS node_id, {EDGE_ID} AS e FROM dep_edges UNION SELECT target_node_id, {EDGE_ID} FROM dep_edges) GROUP BY node_id")
def incident_edges(spark, edges):
    return H.incident_edges(dep_edges(edges)).groupBy("node_id").agg(F.count("*").alias("n"))


@query("dep_groups", recursive=True, sql=""",
r AS (SELECT group_id AS id, parent_group_id AS up, length(title) AS x, length(group_id) AS y FROM dep_groups),
a AS (SELECT id, x, y FROM r WHERE up IS NULL UNION ALL SELECT r.id, r.x + a.x, r.y + a.y FROM r JOIN a ON r.up = a.id)
SELECT id, x AS abs_x, y AS abs_y FROM a""")  # fmt: skip
def absolute_positions(spark, groups):
    placed = one(groups).select("artifact_id", F.col("group_id").alias("id"), F.col("parent_group_id").alias("parent_id"), F.length("title").alias("x"), F.length("group_id").alias("y"))
    return H.absolute_positions(placed).select("id", "abs_x", "abs_y")


@query("dep_groups", "dep_nodes", sql="""
SELECT group_id, CAST(min(k) - 32 AS DOUBLE) AS x, CAST(min(length(title)) - 32 AS DOUBLE) AS y, CAST(max(k + 10) - min(k) + 64 AS DOUBLE) AS width,
  CAST(max(length(title) + 5) - min(length(title)) + 64 AS DOUBLE) AS height
FROM (SELECT *, length(node_id) * 7 % 11 AS k FROM dep_nodes) n WHERE group_id IN (SELECT parent_group_id FROM dep_groups) GROUP BY group_id""")  # fmt: skip
def bundle_bounds(spark, groups, nodes):
    placed = one(nodes).withColumns({"x": F.length("node_id") * 7 % 11, "y": F.length("title"), "width": F.lit(10), "height": F.lit(5)})
    return H.bundle_bounds(placed, one(groups)).drop("artifact_id")


_FLOW = """,
n AS (SELECT DISTINCT source_id AS node_id FROM flow_edges UNION SELECT target_id FROM flow_edges)
"""
_REACH = _FLOW + """, fe AS (SELECT DISTINCT source_id, target_id FROM flow_edges WHERE source_id <> target_id),
reach AS (SELECT source_id AS a, target_id AS b FROM fe UNION SELECT r.a, e.target_id FROM reach r JOIN fe e ON e.source_id = r.b),
scc AS (SELECT n.node_id, least(n.node_id, coalesce(min(x.b), n.node_id)) AS component FROM n LEFT JOIN (SELECT r.a, r.b FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a) x ON x.a = n.node_id GROUP BY n.node_id)
"""  # fmt: skip
_RANKS = _REACH + """, ce AS (SELECT DISTINCT a.component AS s, b.component AS t FROM fe JOIN scc a ON a.node_id = source_id JOIN scc b ON b.node_id = target_id WHERE a.component <> b.component),
lv AS (SELECT component AS c, 0 AS k FROM scc UNION SELECT ce.t, lv.k + 1 FROM lv JOIN ce ON ce.s = lv.c),
rk AS (SELECT c AS component, max(k) AS rank FROM lv GROUP BY c)
"""  # fmt: skip


def _flow(edges):
    e = G.settled(one(edges, "flow"))
    return G.settled(e.select("artifact_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()), e


@query("flow_edges", recursive=True, sql=_FLOW + ", r AS (SELECT min(node_id) AS node_id FROM n UNION SELECT e.target_id FROM r JOIN flow_edges e ON e.source_id = r.node_id) SELECT node_id FROM r")
def reachable(spark, edges):
    nodes, e = _flow(edges)
    seed = nodes.groupBy("artifact_id").agg(F.min("node_id").alias("node_id"))
    return G.reachable(e, seed).select("node_id")


@query("flow_edges", recursive=True, sql=_REACH + "SELECT node_id, component FROM scc")
def strongly_connected(spark, edges):
    return G.strongly_connected(*_flow(edges)).select("node_id", "component")


@query("flow_edges", recursive=True, sql=_RANKS + "SELECT node_id, component, rank FROM scc JOIN rk USING (component)")
def dependency_rank(spark, edges):
    return G.dependency_rank(*_flow(edges)).select("node_id", "component", "rank")


@query("flow_edges", recursive=True, sql=_RANKS + "SELECT node_id, component FROM scc WHERE component NOT IN (SELECT t FROM ce)")
def source_components(spark, edges):
    nodes, e = _flow(edges)
    return G.source_components(e, G.settled(G.strongly_connected(nodes, e))).select("node_id", "component")


@query("flow_edges", recursive=True, sql=_RANKS + """
, lead AS (SELECT s.node_id, s.component, r.rank, min(s.node_id) OVER (PARTITION BY s.component) AS l FROM scc s JOIN rk r USING (component))
SELECT node_id AS item, dense_rank() OVER (ORDER BY rank) AS band, row_number() OVER (PARTITION BY rank ORDER BY l, node_id) AS place FROM lead""")  # fmt: skip
def level_bands(spark, edges):
    ranks = G.dependency_rank(*_flow(edges)).withColumn("scope", F.lit("all")).withColumnRenamed("node_id", "item")
    return H.level_bands(ranks).select("item", "band", "place")


@query("flow_edges", sql=_FLOW + "SELECT CASE WHEN count(*) = 1 THEN min(node_id) END AS root FROM n WHERE node_id NOT IN (SELECT target_id FROM flow_edges)")
def single_root(spark, edges):
    return G.single_root(*_flow(edges)).select("root")


@query("flow_edges", recursive=True, sql=""",
p AS (SELECT source_id AS node_id, min(target_id) AS up FROM flow_edges GROUP BY source_id),
w AS (SELECT node_id AS a, up AS b FROM p WHERE up IS NOT NULL UNION SELECT w.a, p.up FROM w JOIN p ON p.node_id = w.b),
cyc AS (SELECT a FROM w WHERE a = b)
SELECT DISTINCT p.node_id FROM p LEFT JOIN w ON w.a = p.node_id WHERE p.node_id IN (SELECT a FROM cyc) OR w.b IN (SELECT a FROM cyc)""")  # fmt: skip
def pointer_cycles(spark, edges):
    up = one(edges, "flow").groupBy("artifact_id", F.col("source_id").alias("node_id")).agg(F.min("target_id").alias("up"))
    return G.on_pointer_cycles(up).select("node_id")


@query("flow_edges", recursive=True, sql=_REACH + """
, cyc AS (SELECT a AS x FROM reach WHERE a = b UNION SELECT source_id FROM flow_edges WHERE source_id = target_id)
SELECT DISTINCT source_id, target_id FROM flow_edges WHERE target_id IN (SELECT x FROM cyc) OR target_id IN (SELECT a FROM reach WHERE b IN (SELECT x FROM cyc))""")  # fmt: skip
def edges_into_cycles(spark, edges):
    return G.in_cycles_or_before(one(edges, "flow")).select("source_id", "target_id")


@query("flow_edges", sql=_FLOW + """
, e AS (SELECT DISTINCT source_id AS s, target_id AS t, target_id % 3 AS l FROM flow_edges),
c0 AS (SELECT node_id, CAST(node_id % 4 AS VARCHAR) AS c FROM n)
""" + "".join(f""", c{k} AS (SELECT c.node_id, md5(c.c || '|' || coalesce((SELECT string_agg(DISTINCT l || ':' || d.c, ',' ORDER BY l || ':' || d.c) FROM e JOIN c{k - 1} d ON d.node_id = e.t WHERE e.s = c.node_id), '')) AS c FROM c{k - 1} c)
""" for k in range(1, 13)) + "SELECT node_id, min(node_id) OVER (PARTITION BY c) AS representative FROM c12")  # fmt: skip
def merge_equivalent_contexts(spark, edges):
    nodes, e = _flow(edges)
    return G.merge_equivalent(nodes.withColumn("label", (F.col("node_id") % 4).cast("string")), e.withColumn("label", F.col("target_id") % 3)).select("node_id", "representative")


@query("flow_edges", recursive=True, sql=_RANKS + """
, st AS (SELECT component, min(node_id) AS root FROM scc WHERE component NOT IN (SELECT t FROM ce) GROUP BY component),
rr AS (SELECT root, root AS x FROM st UNION SELECT root, e.target_id FROM rr JOIN flow_edges e ON e.source_id = rr.x)
SELECT root, count(*) - 1 AS descendants, max(rank) AS depth FROM rr JOIN scc ON scc.node_id = rr.x JOIN rk USING (component) GROUP BY root""")  # fmt: skip
def route_metrics(spark, edges):
    """Descendants and longest way of each start of routes: the first node of each
    component that nothing else leads to."""
    nodes, e = _flow(edges)
    components = G.settled(G.strongly_connected(nodes, e))
    ranks = G.settled(G.dependency_rank(nodes, e, components))
    first = G.source_components(e, components)
    roots = first.groupBy("artifact_id", "component").agg(F.min("node_id").alias("node_id"))
    # every root is a scenario of its own
    out = G.settled(roots.select("artifact_id", F.col("node_id").alias("root"), "node_id"))
    step = lambda f: f.join(e.select("artifact_id", F.col("source_id").alias("node_id"), "target_id"), ["artifact_id", "node_id"]).select("artifact_id", "root", F.col("target_id").alias("node_id"))
    reach = G.closure(out, step, ["artifact_id", "root", "node_id"])
    return reach.join(ranks.select("artifact_id", "node_id", "rank"), ["artifact_id", "node_id"]).groupBy("root").agg((F.count("*") - 1).alias("descendants"), F.max("rank").alias("depth"))


# integrity of the broken graph

BROKEN = ("dep_groups_broken", "dep_nodes_broken", "dep_edges")


def _messages(df):
    return df.select("code", "message")


@query("dep_groups_broken", sql="SELECT 'unknown_parent_groups' AS code, 'Diagram group ' || group_id || ' has unknown parent ' || parent_group_id AS message FROM dep_groups_broken WHERE parent_group_id NOT IN (SELECT group_id FROM dep_groups_broken)")
def unknown_parent_groups(spark, groups):
    return _messages(V.unknown_parent_groups(one(groups.withColumn("parent_group_id", F.col("parent_group_id")))))


@query("dep_groups_broken", "dep_nodes_broken", sql="SELECT 'unknown_node_groups' AS code, 'Diagram node ' || node_id || ' belongs to unknown group ' || group_id AS message FROM dep_nodes_broken WHERE group_id NOT IN (SELECT group_id FROM dep_groups_broken)")
def unknown_node_groups(spark, groups, nodes):
    return _messages(V.unknown_node_groups(one(nodes), one(groups)))


@query("dep_nodes_broken", "dep_edges", sql=f"""
SELECT 'dangling_edges' AS code, 'Diagram edge ' || {EDGE_ID} || ' sources unknown node ' || source_node_id AS message FROM dep_edges WHERE source_node_id NOT IN (SELECT node_id FROM dep_nodes_broken)
UNION ALL SELECT 'dangling_edges', 'Diagram edge ' || {EDGE_ID} || ' targets unknown node ' || target_node_id FROM dep_edges WHERE target_node_id NOT IN (SELECT node_id FROM dep_nodes_broken)""")  # fmt: skip
def dangling_edges(spark, nodes, edges):
    return _messages(V.dangling_edges(dep_edges(edges), one(nodes)))


@query("dep_groups", sql="SELECT 'group_cycles' AS code, 'Diagram group hierarchy contains a cycle' AS message")
def group_cycles(spark, groups):
    ring = groups.withColumn("parent_group_id", F.when(F.col("group_id") == "world", "nation:1").otherwise(F.col("parent_group_id")))
    return _messages(V.group_cycles(one(ring)))


@query("dep_groups", "dep_nodes", "dep_edges", sql="""
SELECT 'duplicate_element_ids' AS code, 'Duplicate diagram element ID: ' || k AS message
FROM (SELECT l_orderkey || ':' || l_linenumber AS k, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""")  # fmt: skip
def duplicate_element_ids(spark, groups, nodes, edges):
    keys = spark.sql("SELECT 'dep' AS artifact_id, 0 AS ordinal, l_orderkey || ':' || l_linenumber AS edge_id FROM lineitem")
    return _messages(V.duplicate_element_ids(one(groups), one(nodes), keys))


@query(*BROKEN, sql="""
, lay AS (SELECT * FROM (VALUES ('groups', 'bounding'), ('nodes', 'diamond'), ('edges', 'message')) v(element, type)),
el AS (SELECT 'groups' AS element, CASE WHEN length(group_id) % 2 = 0 THEN 'bounding' ELSE 'default' END AS type FROM dep_groups_broken
UNION ALL SELECT 'nodes', CASE WHEN length(node_id) % 5 = 0 THEN 'diamond' ELSE 'default' END FROM dep_nodes_broken
UNION ALL SELECT 'edges', CASE WHEN kind = 'type-only' THEN 'message' ELSE 'default' END FROM dep_edges)
SELECT 'element_type_contract' AS code, 'Layout dependency-graph takes no ' || element || ' of type ' || type AS message, count(*) AS n FROM el JOIN lay USING (element, type) GROUP BY ALL""")  # fmt: skip
def element_type_contract(spark, groups, nodes, edges):
    kind = lambda df, element, c: one(df).select("artifact_id", F.lit(element).alias("element"), "ordinal", c.alias("type"))
    g = kind(groups, "groups", F.when(F.length("group_id") % 2 == 0, "bounding").otherwise("default"))
    n = kind(nodes, "nodes", F.when(F.length("node_id") % 5 == 0, "diamond").otherwise("default"))
    e = kind(edges, "edges", F.when(F.col("kind") == "type-only", "message").otherwise("default"))
    layouts = spark.createDataFrame([("dep", "dependency-graph")], "artifact_id string, layout_id string")
    return V.element_type_contract(g.union(n).union(e), layouts).groupBy("code", "message").agg(F.count("*").alias("n"))


@query(*BROKEN, sql=f"""
SELECT code, count(*) AS n FROM (
SELECT 'unknown_parent_groups' AS code FROM dep_groups_broken WHERE parent_group_id NOT IN (SELECT group_id FROM dep_groups_broken)
UNION ALL SELECT 'unknown_node_groups' FROM dep_nodes_broken WHERE group_id NOT IN (SELECT group_id FROM dep_groups_broken)
UNION ALL SELECT 'dangling_edges' FROM dep_edges WHERE source_node_id NOT IN (SELECT node_id FROM dep_nodes_broken)
UNION ALL SELECT 'dangling_edges' FROM dep_edges WHERE target_node_id NOT IN (SELECT node_id FROM dep_nodes_broken)) GROUP BY code""")  # fmt: skip
def validate_catalog(spark, groups, nodes, edges):
    g, n, e = one(groups), one(nodes), dep_edges(edges)
    layouts = spark.createDataFrame([("dep", "dependency-graph")], "artifact_id string, layout_id string")
    every = [V.unknown_parent_groups(g), V.unknown_node_groups(n, g), V.dangling_edges(e, n), V.group_cycles(g), V.duplicate_element_ids(g, n, e), V.message_endpoint_types(e, n.withColumn("type", F.lit("default")))]
    return V.validate_catalog(layouts, *every).groupBy("code").agg(F.count("*").alias("n"))
