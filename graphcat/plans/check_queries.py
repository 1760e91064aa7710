"""All rules over one catalog of every layout, whose tables break each rule in
some artifacts and keep it in others. A second scope has an intact graph under
the id of a broken one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import search
from ..operators import validate as V
from .catalog import EDGE_ID, dep_edges, one, query
from .fixtures import TABLES

_CUST = "'cust:' || CAST(o_custkey AS STRING)"
_NUMBER = "CAST(SUBSTRING(artifact_id, 6) AS BIGINT)"  # of cust:n and conv:n


def _of(name: str) -> str:
    return f"({TABLES[name]}) t"


TABLES |= {
    "cat_artifacts": f"""
SELECT 'main' AS scope_id, 'dep' AS artifact_id, 'dependency-graph' AS layout_id UNION ALL SELECT 'copy', 'dep', 'dependency-graph'
UNION ALL SELECT DISTINCT 'main', 'conv:' || CAST(conv_id AS STRING), 'sequence' FROM conversations
UNION ALL SELECT DISTINCT 'main', {_CUST}, 'component-structure' FROM orders
UNION ALL SELECT DISTINCT 'main', {_CUST}, 'component-structure' FROM orders WHERE o_custkey % 10 = 0
UNION ALL SELECT 'main', 'none:' || CAST(r_regionkey AS STRING), 'general' FROM region
""",
    "cat_groups": f"""
WITH rings AS (
  SELECT DISTINCT 'conv:' || CAST(conv_id AS STRING) AS artifact_id FROM conversations WHERE conv_id % 10 = 0
  UNION ALL SELECT DISTINCT {_CUST} FROM orders WHERE o_custkey % 2 = 0)
SELECT 'main' AS scope_id, 'dep' AS artifact_id, group_id, parent_group_id, CASE WHEN LENGTH(group_id) % 2 = 0 THEN 'bounding' ELSE 'default' END AS type, 0 AS ordinal FROM {_of("dep_groups_broken")}
UNION ALL SELECT 'copy', 'dep', group_id, parent_group_id, 'default', 0 FROM {_of("dep_groups")}
UNION ALL SELECT 'main', artifact_id, 'x', 'y', 'default', 0 FROM rings UNION ALL SELECT 'main', artifact_id, 'y', 'x', 'default', 1 FROM rings
""",
    "cat_nodes": f"""
SELECT 'main' AS scope_id, 'dep' AS artifact_id, node_id, group_id, CASE WHEN LENGTH(node_id) % 5 = 0 THEN 'diamond' ELSE 'default' END AS type, 0 AS ordinal FROM {_of("dep_nodes_broken")}
UNION ALL SELECT 'copy', 'dep', node_id, group_id, 'default', 0 FROM {_of("dep_nodes")}
UNION ALL SELECT 'main', artifact_id, node_id, CAST(NULL AS STRING), CASE WHEN {_NUMBER} % 2 = 0 AND node_id <> 'assistant' OR {_NUMBER} % 5 = 1 THEN 'default' ELSE 'lifeline' END, ordinal FROM {_of("seq_lifelines")}
UNION ALL SELECT DISTINCT 'main', 'conv:' || CAST(conv_id AS STRING), 'm:0', CAST(NULL AS STRING), 'lifeline', 9 FROM conversations WHERE conv_id % 7 = 0
UNION ALL SELECT DISTINCT 'main', {_CUST}, 'root', CAST(NULL AS STRING), 'default', 0 FROM orders WHERE o_custkey % 9 <> 0
UNION ALL SELECT DISTINCT 'main', artifact_id, target_node_id, CAST(NULL AS STRING), 'default', 1 FROM {_of("comp_requirements")}
""",
    "cat_edges": f"""
SELECT 'main' AS scope_id, 'dep' AS artifact_id, {EDGE_ID} AS edge_id, source_node_id, target_node_id, CASE WHEN kind = 'type-only' THEN 'message' ELSE 'default' END AS type, 0 AS ordinal FROM {_of("dep_edges")}
UNION ALL SELECT 'copy', 'dep', {EDGE_ID}, source_node_id, target_node_id, 'default', 0 FROM {_of("dep_edges")}
UNION ALL SELECT 'main', artifact_id, edge_id, source_node_id, target_node_id, 'message', ordinal FROM {_of("seq_messages")}
UNION ALL SELECT DISTINCT 'main', artifact_id, edge_id, source_node_id, target_node_id, 'control', 0 FROM {_of("comp_requirements")}
""",
    "cat_activations": f"""
SELECT 'main' AS scope_id, artifact_id, node_id, CASE WHEN {_NUMBER} % 4 = 2 THEN 'act' ELSE activation_id END AS activation_id, 0 AS ordinal,
       CASE WHEN {_NUMBER} % 3 = 0 THEN end_message_id ELSE start_message_id END AS start_message_id, start_endpoint,
       CASE WHEN {_NUMBER} % 3 = 0 THEN start_message_id WHEN {_NUMBER} % 5 = 0 THEN 'gone' ELSE end_message_id END AS end_message_id, end_endpoint
FROM {_of("seq_activations")}
""",
    "cat_branches": f"""
SELECT 'main' AS scope_id, artifact_id, fragment_id, branch_id, 0 AS ordinal,
       CASE WHEN {_NUMBER} % 3 = 1 THEN end_message_id ELSE start_message_id END AS start_message_id,
       CASE WHEN {_NUMBER} % 3 = 1 THEN start_message_id WHEN {_NUMBER} % 4 = 0 THEN 'gone' ELSE end_message_id END AS end_message_id
FROM {_of("seq_branches")}
""",
    "cat_roots": f"""
SELECT DISTINCT 'main' AS scope_id, {_CUST} AS artifact_id, 0 AS ordinal, 'root' AS node_id FROM orders WHERE o_custkey % 4 <> 2
UNION ALL SELECT DISTINCT 'main', {_CUST}, 1, CASE WHEN o_custkey % 4 = 0 THEN 'root' ELSE 'nowhere' END FROM orders WHERE o_custkey % 4 < 2
""",
    "cat_controls": f"""
SELECT 'main' AS scope_id, artifact_id, control_id, type, CASE WHEN {_NUMBER} % 5 = 1 AND control_id = 'flag' THEN 'gone' ELSE owner_node_id END AS owner_node_id, ordinal FROM {_of("comp_controls")}
UNION ALL SELECT DISTINCT 'main', {_CUST}, 'line', 'conditional', 'root', 3 FROM orders WHERE o_custkey % 6 = 1
""",
    "cat_cases": f"""
SELECT 'main' AS scope_id, artifact_id, control_id, case_id, ordinal FROM {_of("comp_cases")} WHERE {_NUMBER} % 2 = 1 OR case_id <> 'P'
UNION ALL SELECT DISTINCT 'main', {_CUST}, 'flag', 'X', 4 FROM orders WHERE o_custkey % 8 = 0
""",
    "cat_aux": f"""
SELECT DISTINCT 'main' AS scope_id, {_CUST} AS artifact_id, 'a' AS definition_id, 0 AS ordinal FROM orders
UNION ALL SELECT DISTINCT 'main', {_CUST}, CASE WHEN o_custkey % 3 = 0 THEN 'a' ELSE 'b' END, 1 FROM orders
""",
    "cat_requirements": f"""
SELECT 'main' AS scope_id, artifact_id, edge_id, rule_ix, req_ix, control_id, value FROM {_of("comp_requirements")}
UNION ALL SELECT 'main', {_CUST}, 'o:' || CAST(o_orderkey AS STRING), 0, 1, 'status', CASE o_orderstatus WHEN 'O' THEN 'F' ELSE 'O' END FROM orders WHERE o_custkey % 5 = 0
UNION ALL SELECT 'main', {_CUST}, 'o:' || CAST(o_orderkey AS STRING), 1, 0, 'lost', 'on' FROM orders WHERE o_custkey % 7 = 0
""",
    "cat_prerequisites": f"""
SELECT 'main' AS scope_id, artifact_id, control_id, rule_ix, req_ix, req_control_id, value FROM {_of("comp_prerequisites")}
UNION ALL SELECT DISTINCT 'main', {_CUST}, 'status', 0, 0, 'flag', 'A' FROM orders WHERE o_custkey % 6 = 0
""",
}
CATALOG = tuple(t for t in TABLES if t.startswith("cat_"))

_TYPES = ", ".join(f"('{e}', '{layout}', '{t}')" for e, layout, t in V.ELEMENT_TYPES)
_UNKNOWN_END = lambda side: f"NOT EXISTS (SELECT 1 FROM cat_nodes n WHERE n.scope_id = e.scope_id AND n.artifact_id = e.artifact_id AND n.node_id = e.{side}_node_id"


def _repeated(table: str, key: str) -> str:
    return f"SELECT scope_id, artifact_id FROM (SELECT scope_id, artifact_id, row_number() OVER (PARTITION BY scope_id, artifact_id, {key}) AS n FROM {table}) WHERE n > 1"


def _messages_of(table: str, alias: str) -> str:
    sides = (f"LEFT JOIN msg {k} ON {k}.scope_id = {alias}.scope_id AND {k}.artifact_id = {alias}.artifact_id AND {k}.edge_id = {alias}.{side}_message_id" for k, side in (("s", "start"), ("e", "end")))
    return f"FROM {table} {alias} " + " ".join(sides)


_FOUND = {
    "duplicate_element_ids": _repeated("(SELECT scope_id, artifact_id, group_id AS id FROM cat_groups UNION ALL SELECT scope_id, artifact_id, node_id FROM cat_nodes UNION ALL SELECT scope_id, artifact_id, edge_id FROM cat_edges)", "id"),
    "unknown_parent_groups": "SELECT scope_id, artifact_id FROM cat_groups g WHERE parent_group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat_groups p WHERE p.scope_id = g.scope_id AND p.artifact_id = g.artifact_id AND p.group_id = g.parent_group_id)",
    "group_cycles": "SELECT DISTINCT scope_id, artifact_id FROM up WHERE a = b",
    "unknown_node_groups": "SELECT scope_id, artifact_id FROM cat_nodes n WHERE group_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat_groups g WHERE g.scope_id = n.scope_id AND g.artifact_id = n.artifact_id AND g.group_id = n.group_id)",
    "dangling_edges": " UNION ALL ".join(f"SELECT scope_id, artifact_id FROM cat_edges e WHERE {_UNKNOWN_END(s)})" for s in ("source", "target")),
    "message_endpoint_types": " UNION ALL ".join(f"SELECT scope_id, artifact_id FROM cat_edges e WHERE type = 'message' AND {_UNKNOWN_END(s)} AND n.type = 'lifeline')" for s in ("source", "target")),
    "sequence_shape": """SELECT scope_id, artifact_id FROM a WHERE NOT EXISTS (SELECT 1 FROM cat_nodes n WHERE n.scope_id = a.scope_id AND n.artifact_id = a.artifact_id)
UNION ALL SELECT scope_id, artifact_id FROM a WHERE layout_id = 'sequence' AND EXISTS (SELECT 1 FROM cat_groups g WHERE g.scope_id = a.scope_id AND g.artifact_id = a.artifact_id)
UNION ALL SELECT scope_id, artifact_id FROM a WHERE layout_id = 'sequence' AND NOT EXISTS (SELECT 1 FROM cat_nodes n WHERE n.scope_id = a.scope_id AND n.artifact_id = a.artifact_id AND n.type = 'lifeline')""",
    "activation_issues": _repeated("cat_activations", "node_id, activation_id") + "".join(f" UNION ALL SELECT x.scope_id, x.artifact_id {_messages_of('cat_activations', 'x')} WHERE {w}" for w in (
        "s.edge_id IS NULL", "e.edge_id IS NULL", "s.edge_id IS NOT NULL AND CASE start_endpoint WHEN 'source' THEN s.source_node_id ELSE s.target_node_id END <> x.node_id",
        "e.edge_id IS NOT NULL AND CASE end_endpoint WHEN 'source' THEN e.source_node_id ELSE e.target_node_id END <> x.node_id", "s.ordinal > e.ordinal")),
    "fragment_branch_issues": _repeated("cat_branches", "fragment_id, branch_id") + "".join(f" UNION ALL SELECT x.scope_id, x.artifact_id {_messages_of('cat_branches', 'x')} WHERE {w}" for w in ("s.edge_id IS NULL", "e.edge_id IS NULL", "s.ordinal > e.ordinal")),
    "root_issues": "SELECT scope_id, artifact_id FROM (SELECT *, row_number() OVER (PARTITION BY scope_id, artifact_id, node_id ORDER BY ordinal) AS n FROM cat_roots) r WHERE n > 1 OR NOT EXISTS (SELECT 1 FROM cat_nodes n WHERE n.scope_id = r.scope_id AND n.artifact_id = r.artifact_id AND n.node_id = r.node_id)",
    "control_issues": f"{_repeated('cat_controls', 'control_id')} UNION ALL {_repeated('cat_cases', 'control_id, case_id')} UNION ALL SELECT scope_id, artifact_id FROM cat_controls c WHERE NOT EXISTS (SELECT 1 FROM cat_nodes n WHERE n.scope_id = c.scope_id AND n.artifact_id = c.artifact_id AND n.node_id = c.owner_node_id)",
    "aux_definition_duplicates": _repeated("cat_aux", "definition_id"),
    "ruleset_issues": """SELECT scope_id, artifact_id FROM (SELECT *, lag(value) OVER (PARTITION BY scope_id, artifact_id, owner, rule_ix, control_id ORDER BY req_ix) AS before FROM req) WHERE before <> value
UNION ALL SELECT scope_id, artifact_id FROM req r WHERE control_id NOT IN ('status', 'flag', 'line')
UNION ALL SELECT scope_id, artifact_id FROM req r WHERE control_id = 'line' AND value NOT IN ('on', 'off')
UNION ALL SELECT scope_id, artifact_id FROM req r WHERE control_id IN ('status', 'flag') AND NOT EXISTS (SELECT 1 FROM cat_cases c WHERE c.scope_id = r.scope_id AND c.artifact_id = r.artifact_id AND c.control_id = r.control_id AND c.case_id = r.value)""",
    "undeclared_roots": """SELECT scope_id, artifact_id FROM cat_nodes n WHERE NOT EXISTS (SELECT 1 FROM cat_edges e WHERE e.scope_id = n.scope_id AND e.artifact_id = n.artifact_id AND e.target_node_id = n.node_id)
AND NOT EXISTS (SELECT 1 FROM cat_roots r WHERE r.scope_id = n.scope_id AND r.artifact_id = n.artifact_id AND r.node_id = n.node_id)""",
    "control_cycles": "SELECT DISTINCT p.scope_id, p.artifact_id FROM cat_prerequisites p JOIN cat_prerequisites q ON q.scope_id = p.scope_id AND q.artifact_id = p.artifact_id AND q.control_id = p.req_control_id AND q.req_control_id = p.control_id",
}

_CHECK = """,
a AS (SELECT DISTINCT * FROM cat_artifacts), types(element, layout_id, type) AS (VALUES """ + _TYPES + """),
msg AS (SELECT * FROM cat_edges WHERE type = 'message'),
req AS (SELECT scope_id, artifact_id, 'e' || edge_id AS owner, rule_ix, req_ix, control_id, value FROM cat_requirements UNION ALL SELECT scope_id, artifact_id, 'c' || control_id, rule_ix, req_ix, req_control_id, value FROM cat_prerequisites),
up AS (SELECT scope_id, artifact_id, group_id AS a, parent_group_id AS b FROM cat_groups WHERE parent_group_id IS NOT NULL
  UNION SELECT u.scope_id, u.artifact_id, u.a, g.parent_group_id FROM up u JOIN cat_groups g ON g.scope_id = u.scope_id AND g.artifact_id = u.artifact_id AND g.group_id = u.b WHERE g.parent_group_id IS NOT NULL),
found AS (""" + "\nUNION ALL ".join(f"SELECT '{code}' AS code, f.scope_id, f.artifact_id, layout_id FROM ({sql}) f JOIN a USING (scope_id, artifact_id) WHERE (layout_id = 'component-structure') = {'true' if code in V.COMPONENT else 'false'}" for code, sql in _FOUND.items()) + """
UNION ALL SELECT 'element_type_contract', scope_id, artifact_id, layout_id FROM (SELECT 'groups' AS element, scope_id, artifact_id, type FROM cat_groups UNION ALL SELECT 'nodes', scope_id, artifact_id, type FROM cat_nodes UNION ALL SELECT 'edges', scope_id, artifact_id, type FROM cat_edges)
  JOIN a USING (scope_id, artifact_id) ANTI JOIN types USING (element, layout_id, type)
UNION ALL SELECT 'duplicate_artifacts', scope_id, artifact_id, layout_id FROM (""" + _repeated("cat_artifacts", "artifact_id") + """) JOIN a USING (scope_id, artifact_id))
SELECT code, scope_id, artifact_id, count(*) AS n FROM found GROUP BY ALL"""  # fmt: skip


@query(*CATALOG, recursive=True, sql=_CHECK)
def check_graphs(spark, artifacts, groups, nodes, edges, activations, branches, roots, controls, cases, aux, requirements, prerequisites):
    tables = {"groups": groups, "nodes": nodes, "edges": edges, "activations": activations, "branches": branches, "roots": roots, "controls": controls, "cases": cases, "aux_definitions": aux, "requirements": requirements, "prerequisites": prerequisites}
    return V.check_graphs(artifacts, tables).groupBy("code", "scope_id", "artifact_id").agg(F.count("*").alias("n"))


@query("dep_edges", sql="""
SELECT source_node_id AS source_id, target_node_id AS target_id, 'aggregate:["' || source_node_id || '","' || target_node_id || '"]' || CASE WHEN length(source_node_id) % 3 > 0 THEN '' WHEN length(target_node_id) % 2 = 0 THEN '::' ELSE ':' END AS aggregate_id
FROM (SELECT DISTINCT source_node_id, target_node_id FROM dep_edges)""")  # fmt: skip
def aggregate_ids(spark, edges):
    """Ids of all pairs of ends, a third of them reserved, some of these with a colon, too."""
    pairs = one(edges).select("artifact_id", F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id")).distinct()
    base = F.concat(F.lit('aggregate:["'), "source_id", F.lit('","'), "target_id", F.lit('"]'))
    third = pairs.filter(F.length("source_id") % 3 == 0)
    reserved = third.select("artifact_id", base.alias("id")).union(third.filter(F.length("target_id") % 2 == 0).select("artifact_id", F.concat(base, F.lit(":")))).union(dep_edges(edges).select("artifact_id", "edge_id"))
    return H.aggregate_ids(pairs, reserved).drop("artifact_id")


@query("page_links", "page_paths", sql="""
, l AS (SELECT page_id, 'artifact' AS kind, CAST(NULL AS VARCHAR) AS element_id, h AS href, CASE length(h) % 3 WHEN 0 THEN 'text' WHEN 1 THEN '' END AS text FROM page_links, unnest(hrefs) AS t(h)
  UNION ALL SELECT page_id, 'node', 'n:' || page_id, href || CASE WHEN page_id % 2 = 0 THEN '#L3' ELSE '' END, NULL FROM page_paths
  UNION ALL SELECT page_id, 'edge', 'e:' || page_id, replace(href, 'source:///', CASE page_id % 3 WHEN 0 THEN 'https://' WHEN 1 THEN 'source://host/' ELSE 'source:' END), NULL FROM page_paths WHERE page_id % 5 <> 0)
SELECT page_id, kind, element_id, href, coalesce(nullif(text, ''), CASE WHEN starts_with(href, 'source:') THEN nullif(regexp_extract(href, '^source:(?://[^/?#]*)?([^?#]*/)?([^?#/]*)', 2), '') END, href) AS label FROM l""")  # fmt: skip
def link_labels(spark, hrefs, paths):
    """Links of artifacts, nodes and edges made of all pages."""
    key = F.col("page_id").alias("artifact_id")
    href = F.explode("hrefs").alias("href")
    of_pages = hrefs.select(key, F.lit("artifact").alias("kind"), F.lit(None).cast("string").alias("element_id"), href).withColumn("text", F.when(F.length("href") % 3 == 0, "text").when(F.length("href") % 3 == 1, ""))
    of_nodes = paths.select(key, F.lit("node").alias("kind"), F.concat(F.lit("n:"), "page_id").alias("element_id"), F.concat("href", F.when(F.col("page_id") % 2 == 0, "#L3").otherwise("")).alias("href"), F.lit(None).cast("string").alias("text"))
    start = F.when(F.col("page_id") % 3 == 0, "https://").when(F.col("page_id") % 3 == 1, "source://host/").otherwise("source:")
    edges = paths.select(key, F.concat(F.lit("e:"), "page_id").alias("edge_id"), F.when(F.col("page_id") % 5 != 0, F.replace("href", F.lit("source:///"), start)).alias("href"))
    every = search.link_inventory(of_pages.union(of_nodes.select(of_pages.columns)).withColumn("link_ix", F.lit(0)), edges)
    return every.select(F.col("artifact_id").alias("page_id"), "kind", "element_id", "href", "label")
