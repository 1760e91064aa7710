"""Graph analytics on many graphs of some structure at once: those of all
customers, from supplier to supplier along each order's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import validate as V
from .catalog import query
from .fixtures import TABLES

TABLES["customer_edges"] = """
WITH l AS (
  SELECT o_custkey, l_orderkey, l_suppkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT DISTINCT 'cust:' || CAST(a.o_custkey AS STRING) AS artifact_id, a.l_suppkey AS source_id, b.l_suppkey AS target_id
FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.rn = a.rn + 1
"""

_REACH = """,
g AS MATERIALIZED (SELECT artifact_id AS a, source_id AS s, target_id AS t FROM customer_edges),
reach AS MATERIALIZED (SELECT a, s, t FROM g WHERE s <> t UNION SELECT r.a, r.s, g.t FROM reach r JOIN g ON g.a = r.a AND g.s = r.t)
"""
_CYCLIC = """, cyc AS (SELECT a, s AS x FROM reach WHERE s = t UNION SELECT a, s FROM g WHERE s = t)"""


def _nodes(edges):
    return G.settled(edges.select("artifact_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct())


@query("customer_edges", sql=""",
n AS (SELECT artifact_id, source_id AS x FROM customer_edges UNION SELECT artifact_id, target_id FROM customer_edges),
f AS (SELECT n.artifact_id, CASE WHEN e.t IS NULL THEN n.x END AS x FROM n LEFT JOIN (SELECT DISTINCT artifact_id, target_id AS t FROM customer_edges) e ON e.artifact_id = n.artifact_id AND e.t = n.x)
SELECT artifact_id, CASE WHEN count(x) = 1 THEN min(x) END AS root FROM f GROUP BY artifact_id""")  # fmt: skip
def customer_roots(spark, edges):
    return G.single_root(_nodes(edges), edges).select("artifact_id", "root")


@query("customer_edges", recursive=True, sql=_REACH + _CYCLIC + "SELECT DISTINCT a AS artifact_id, 'Component control prerequisites contain a cycle' AS message FROM cyc")
def customer_cycles(spark, edges):
    p = edges.select("artifact_id", F.col("source_id").alias("control_id"), F.col("target_id").alias("req_control_id"))
    return V.control_cycles(p).select("artifact_id", "message")


