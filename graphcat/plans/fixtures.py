"""Derived input tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations", "documents")

TABLES = {
    "dep_groups": r"""
SELECT 'world' AS group_id, 'World' AS title, CAST(NULL AS STRING) AS parent_group_id, FALSE AS synthetic
UNION ALL SELECT 'region:' || CAST(r_regionkey AS STRING), r_name, 'world', FALSE FROM region
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), n_name, 'region:' || CAST(n_regionkey AS STRING), FALSE FROM nation
UNION ALL SELECT 'group:external-packages', 'External packages', CAST(NULL AS STRING), TRUE
""",
    "dep_nodes": r"""
SELECT 'supplier:' || CAST(s_suppkey AS STRING) AS node_id, s_name AS title,
       CASE WHEN s_suppkey % 10 = 0 THEN 'region:' || CAST(n_regionkey AS STRING) ELSE 'nation:' || CAST(n_nationkey AS STRING) END AS group_id,
       FALSE AS synthetic
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'customer:' || CAST(c_custkey AS STRING), c_name, 'nation:' || CAST(c_nationkey AS STRING), FALSE FROM customer
UNION ALL SELECT DISTINCT 'external:' || p_brand, p_brand, 'group:external-packages', TRUE FROM part
""",
    "dep_edges": r"""
SELECT DISTINCT 'customer:' || CAST(o_custkey AS STRING) AS source_node_id, 'supplier:' || CAST(l_suppkey AS STRING) AS target_node_id,
       CASE WHEN l_linestatus = 'F' THEN 'type-only' ELSE 'runtime' END AS kind
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT DISTINCT 'supplier:' || CAST(l_suppkey AS STRING), 'external:' || p_brand, 'runtime'
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    "flow_edges": r"""
WITH l AS (
  SELECT l_orderkey, l_partkey,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem)
SELECT DISTINCT a.l_partkey AS source_id, b.l_partkey AS target_id
FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1
""",
    "seq_messages": r"""
SELECT 'conv:' || CAST(conv_id AS STRING) AS artifact_id, 'm:' || CAST(turn AS STRING) AS edge_id, role AS source_node_id,
       COALESCE(LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn), role) AS target_node_id,
       CASE role WHEN 'assistant' THEN 'return' WHEN 'system' THEN 'async' ELSE 'sync' END AS message_type, turn AS ordinal
FROM conversations
""",
    "seq_lifelines": r"""
SELECT 'conv:' || CAST(conv_id AS STRING) AS artifact_id, role AS node_id, MIN(turn) AS ordinal,
       160 + 10 * LENGTH(role) AS width, 100 + 20 * (MIN(turn) % 3) AS height
FROM conversations GROUP BY conv_id, role
""",
    "seq_branches": r"""
SELECT 'conv:' || CAST(conv_id AS STRING) AS artifact_id, 'f:' || CAST(turn - turn % 4 AS STRING) AS fragment_id,
       'b:' || CAST(turn - turn % 2 AS STRING) AS branch_id,
       'm:' || CAST(MIN(turn) AS STRING) AS start_message_id, 'm:' || CAST(MAX(turn) AS STRING) AS end_message_id
FROM conversations GROUP BY conv_id, turn - turn % 4, turn - turn % 2
""",
    "seq_activations": r"""
SELECT 'conv:' || CAST(conv_id AS STRING) AS artifact_id, role AS node_id, 'act:' || CAST(turn AS STRING) AS activation_id,
       'm:' || CAST(turn - 1 AS STRING) AS start_message_id, 'target' AS start_endpoint,
       'm:' || CAST(turn AS STRING) AS end_message_id, 'source' AS end_endpoint
FROM conversations WHERE role = 'assistant'
""",
    "walk_elements": r"""
SELECT 'conv:' || CAST(conv_id AS STRING) AS artifact_id, turn AS step, 'edge' AS type, 'm:' || CAST(turn + 1 AS STRING) AS id FROM conversations
UNION ALL SELECT 'conv:' || CAST(conv_id AS STRING), turn, 'node', role FROM conversations
UNION ALL SELECT 'conv:' || CAST(conv_id AS STRING), turn, 'group', 'g' FROM conversations WHERE turn % 5 = 4
""",
    "comp_requirements": r"""
WITH e AS (
  SELECT DISTINCT o_custkey, o_orderkey, p_brand, l_returnflag, l_linestatus
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
r AS (
  SELECT *, DENSE_RANK() OVER (PARTITION BY o_orderkey, p_brand ORDER BY l_returnflag, l_linestatus) - 1 AS rule_ix FROM e)
SELECT 'cust:' || CAST(o_custkey AS STRING) AS artifact_id, 'o:' || CAST(o_orderkey AS STRING) AS edge_id, 'root' AS source_node_id,
       'order:' || CAST(o_orderkey AS STRING) AS target_node_id, 0 AS rule_ix, 0 AS req_ix, 'status' AS control_id, o_orderstatus AS value
FROM orders
UNION ALL
SELECT 'cust:' || CAST(o_custkey AS STRING), 'b:' || CAST(o_orderkey AS STRING) || ':' || p_brand, 'order:' || CAST(o_orderkey AS STRING),
       'brand:' || p_brand, rule_ix, 0, 'flag', l_returnflag FROM r
UNION ALL
SELECT 'cust:' || CAST(o_custkey AS STRING), 'b:' || CAST(o_orderkey AS STRING) || ':' || p_brand, 'order:' || CAST(o_orderkey AS STRING),
       'brand:' || p_brand, rule_ix, 1, 'line', CASE WHEN l_linestatus = 'O' THEN 'on' ELSE 'off' END FROM r
""",
    "ann_log": r"""
SELECT 'user:' || CAST(user_id AS STRING) AS scope_id, 'a:' || CAST(event_id % 3 AS STRING) AS annotation_id, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'publish' WHEN 'click' THEN 'move' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'remove' ELSE 'open' END AS op,
       CASE WHEN event_id % 11 = 0 THEN '  ' ELSE props END AS body, value AS x, CAST(event_id % 100 AS DOUBLE) AS y
FROM events
""",
    "page_paths": r"""
SELECT page_id, REGEXP_EXTRACT(url, '^https?://([^/?#]+)', 1) AS host, REGEXP_EXTRACT(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
       'source:///' || REGEXP_EXTRACT(url, '^https?://(.*)$', 1) AS href
FROM pages
""",
    "page_links": r"""
SELECT page_id, REGEXP_EXTRACT_ALL(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages
""",
    "dep_candidates": r"""
SELECT l_orderkey AS source, l_partkey AS specifier,
       CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'require' ELSE 'types' END AS pass,
       MIN(l_suppkey) AS resolved, MIN(l_linestatus) = 'F' AS could_not_resolve, MAX(l_discount) > 0.08 AS type_only
FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag
""",
    "conditions": r"""
SELECT 'part:' || CAST(p_partkey AS STRING) AS control_id, p_brand AS owner, 'equal' AS family, 'size' AS subject,
       CAST(p_size AS STRING) AS literal, p_partkey % 2 = 0 AS inverted
FROM part
""",
    "segments": r"""
SELECT user_id AS artifact_id, event_id AS segment_id,
       CASE WHEN event_type IN ('click', 'view') THEN 'horizontal' ELSE 'vertical' END AS axis,
       EXTRACT(MINUTE FROM ts) AS x1, FLOOR(value) AS y1,
       EXTRACT(MINUTE FROM ts) + CASE WHEN event_type IN ('click', 'view') THEN 20 ELSE 0 END AS x2,
       FLOOR(value) + CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 30 END AS y2
FROM events
""",
}

# Graphs that break rules, and other variants.
TABLES |= {
    "dep_groups_broken": "SELECT * FROM (" + TABLES["dep_groups"] + ") g WHERE group_id NOT IN ('nation:0', 'region:0')",
    "dep_nodes_broken": "SELECT * FROM (" + TABLES["dep_nodes"] + ") n WHERE NOT (node_id LIKE 'supplier:%' AND TRY_CAST(SUBSTRING(node_id, 10) AS BIGINT) % 7 = 0)",
    "comp_controls": """
SELECT DISTINCT 'cust:' || CAST(o_custkey AS STRING) AS artifact_id, c.control_id, c.type, 'root' AS owner_node_id, c.label, c.ordinal
FROM orders, (SELECT 'status' AS control_id, 'branch' AS type, 'Status' AS label, 0 AS ordinal
UNION ALL SELECT 'flag', 'branch', 'Flag', 1 UNION ALL SELECT 'line', 'conditional', 'Line', 2) c
""",
    "comp_cases": """
SELECT DISTINCT 'cust:' || CAST(o_custkey AS STRING) AS artifact_id, c.control_id, c.case_id, c.label, c.ordinal
FROM orders, (SELECT 'status' AS control_id, 'F' AS case_id, 'Filled' AS label, 0 AS ordinal UNION ALL SELECT 'status', 'O', 'Open', 1
UNION ALL SELECT 'status', 'P', 'Partial', 2 UNION ALL SELECT 'flag', 'A', 'Accepted', 0 UNION ALL SELECT 'flag', 'N', 'New', 1
UNION ALL SELECT 'flag', 'R', 'Returned', 2 UNION ALL SELECT 'flag', 'X', 'None', 3) c
""",
    "comp_prerequisites": """
SELECT DISTINCT 'cust:' || CAST(o_custkey AS STRING) AS artifact_id, 'flag' AS control_id, 0 AS rule_ix, 0 AS req_ix, 'status' AS req_control_id, 'O' AS value
FROM orders
""",
    "page_hrefs": "SELECT p.page_id, p.host, p.path, p.href FROM (" + TABLES["page_paths"] + ") p",
}


def view_all(spark: SparkSession, sf_dir: str) -> None:
    for name in RAW:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
PART_BYTES = 4 << 20  #: input files that a task reads, and a partition of a shuffle; rows are about ten times as large in memory
MOST_BYTES = 4 << 20  #: what a task fetches where Spark joins small partitions; its sorts, windows and groups each hold these rows


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def deal_out(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Gives the session as many shuffle partitions as the input needs, so that a
    task's share stays the same when tables grow; Spark joins small ones again.
    Settings that are finer already stay. A small side of a join is sent to all
    tasks even if its keys are few, else one artifact's rows are one task's."""
    texts = " ".join(TABLES[t] for t in tables)
    named = [n for n in RAW if n in STAR or re.search(rf"\b{n}\b", texts)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = [path(f"{sf_dir}/{n}.parquet") for n in named]
    total = sum(f.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(f).getLength() for f in files)
    if (n := -(-total // PART_BYTES)) > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
    for name, most in (("spark.sql.files.maxPartitionBytes", PART_BYTES), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", MOST_BYTES)):
        if _bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, most)
    spark.conf.set("spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin", 0)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table. Names in its text are resolved at once, so a later call
    for another folder does no harm."""
    view_all(spark, sf_dir)
    return spark.sql(TABLES[name])


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    view_all(spark, sf_dir)
    return [spark.sql(TABLES[name]) for name in names]


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """DuckDB text: the derived tables that it names, then the body. A body that
    starts with a comma adds common tables of its own."""
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in names)
    body = body.strip()
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + ((" " + body) if body.startswith(",") else f"\n{body}")
