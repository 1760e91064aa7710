"""Queries on conditions folded into controls, and rulesets rewritten."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folding
from .catalog import query
from .fixtures import TABLES

# Parts are conditions of the root of their type: three in four compare a size with one of
# three literals, the others are polarities of flags, some of them branches.
TABLES["fold_conditions"] = """
SELECT p_type AS artifact_id, 'part:' || p_partkey AS control_id, CAST(p_partkey AS BIGINT) AS creation_ix, 'root' AS owner,
  CASE WHEN p_partkey % 8 = 4 THEN 'branch' ELSE 'conditional' END AS type, CASE WHEN p_partkey % 4 = 0 THEN 'truth' ELSE 'equal' END AS family,
  CASE WHEN p_partkey % 4 = 0 THEN 'flag' || p_brand ELSE 'size of ' || p_brand END AS subject,
  CASE WHEN p_partkey % 4 <> 0 THEN 's' || CAST(p_size % 3 + p_partkey % 2 AS STRING) END AS literal,
  p_partkey % 3 = 0 AS inverted, 'is ' || p_name || ' ' || CAST(p_partkey AS STRING) AS label, 'not ' || CAST(p_partkey AS STRING) AS other_label
FROM part
"""
# Lines are requirements of their order, in rules by return flag; an artifact's rules name its parts only.
TABLES["fold_requirements"] = """
SELECT p_type AS artifact_id, 'o:' || CAST(l_orderkey AS STRING) AS edge_id, ASCII(l_returnflag) AS rule_ix, CAST(ROW_NUMBER() OVER (PARTITION BY p_type, l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS req_ix,
  'part:' || CAST(l_partkey AS STRING) AS control_id,
  CASE WHEN l_quantity > 48 THEN 'odd' WHEN (l_partkey % 8 = 4) = (l_linestatus = 'O') THEN CASE WHEN l_partkey % 8 = 4 THEN 'true' ELSE 'off' END
    ELSE CASE WHEN l_partkey % 8 = 4 THEN 'false' ELSE 'on' END END AS value
FROM lineitem JOIN part ON p_partkey = l_partkey
"""

_CHOICES = """,
c AS MATERIALIZED (SELECT * FROM fold_conditions),
q AS MATERIALIZED (SELECT r.*, c.owner, c.family, c.subject, c.literal, c.type, (value IN ('on', 'true')) <> inverted AS positive,
  CASE WHEN type = 'branch' THEN value NOT IN ('true', 'false') ELSE value NOT IN ('on', 'off') END AS odd
  FROM fold_requirements r JOIN c ON c.artifact_id = r.artifact_id AND c.control_id = r.control_id),
ch AS MATERIALIZED (SELECT artifact_id, edge_id, rule_ix, owner, subject, min(req_ix) AS slot, arg_min(literal, req_ix) FILTER (positive) AS chosen,
  coalesce(list(DISTINCT literal) FILTER (NOT positive), []) AS denied, bool_or(odd) AS odd FROM q WHERE family = 'equal' GROUP BY ALL),
rs AS (SELECT DISTINCT artifact_id, owner, subject FROM ch WHERE chosen IS NULL),
su AS MATERIALIZED (SELECT c.artifact_id, c.owner, c.subject, arg_min(control_id, creation_ix) AS folded, arg_min(inverted, creation_ix) AS head_inverted,
  arg_min(label, creation_ix) AS label, count(DISTINCT literal) AS n, bool_or(rs.owner IS NOT NULL) AS rest
  FROM c LEFT JOIN rs ON rs.artifact_id = c.artifact_id AND rs.owner = c.owner AND rs.subject = c.subject WHERE family = 'equal' GROUP BY ALL),
li AS (SELECT artifact_id, owner, subject, literal, min(creation_ix) AS first_ix FROM c WHERE family = 'equal' GROUP BY ALL),
tx AS (SELECT artifact_id, owner, subject, control_id, inverted AS negative, label AS text, creation_ix * 2 AS pl FROM c WHERE family = 'truth'
  UNION ALL SELECT artifact_id, owner, subject, control_id, NOT inverted, other_label, creation_ix * 2 + 1 FROM c WHERE family = 'truth' AND type = 'branch'),
sz AS (SELECT artifact_id, owner, subject, count(*) AS n, bool_or(type <> 'branch') AS some FROM c WHERE family = 'truth' GROUP BY ALL),
pa AS MATERIALIZED (SELECT tx.artifact_id, tx.owner, tx.subject, arg_min(text, pl) FILTER (NOT negative) AS yes, arg_min(text, pl) FILTER (negative) AS no,
  arg_min(control_id, pl) AS folded, arg_min(text, pl) AS first_text
  FROM tx JOIN sz ON sz.artifact_id = tx.artifact_id AND sz.owner = tx.owner AND sz.subject = tx.subject WHERE sz.n > 1 OR sz.some GROUP BY ALL)
"""

_FOLDED = _CHOICES + """
SELECT artifact_id, folded AS control_id, owner, CASE WHEN n < 2 AND NOT rest THEN 'conditional' ELSE 'branch' END AS type,
  CASE WHEN n < 2 AND NOT rest THEN label ELSE subject END AS label, FALSE AS polarity_pair, CASE WHEN n < 2 AND NOT rest THEN 0 ELSE n + CASE WHEN rest THEN 1 ELSE 0 END END AS n_cases FROM su
UNION ALL SELECT artifact_id, folded, owner, CASE WHEN yes IS NULL OR no IS NULL THEN 'conditional' ELSE 'branch' END, CASE WHEN yes IS NULL OR no IS NULL THEN first_text ELSE yes END,
  yes IS NOT NULL AND no IS NOT NULL, CASE WHEN yes IS NULL OR no IS NULL THEN 0 ELSE 2 END FROM pa
UNION ALL SELECT c.artifact_id, c.control_id, c.owner, c.type, c.label, FALSE, 2 FROM c LEFT JOIN pa ON pa.artifact_id = c.artifact_id AND pa.owner = c.owner AND pa.subject = c.subject WHERE c.family = 'truth' AND pa.owner IS NULL
"""  # fmt: skip

_REWRITTEN = _CHOICES + """,
al AS MATERIALIZED (
  SELECT ch.artifact_id, edge_id, rule_ix, slot, folded AS control_id, CASE WHEN n < 2 AND NOT rest THEN CASE WHEN (chosen IS NOT NULL) <> head_inverted THEN 'on' ELSE 'off' END ELSE chosen END AS value
  FROM ch JOIN su ON su.artifact_id = ch.artifact_id AND su.owner = ch.owner AND su.subject = ch.subject
  WHERE NOT odd AND (chosen IS NOT NULL OR (n < 2 AND NOT rest)) AND NOT coalesce(list_contains(denied, chosen), FALSE)
  UNION ALL SELECT ch.artifact_id, edge_id, rule_ix, slot, folded, literal FROM ch JOIN su ON su.artifact_id = ch.artifact_id AND su.owner = ch.owner AND su.subject = ch.subject
  JOIN li ON li.artifact_id = ch.artifact_id AND li.owner = ch.owner AND li.subject = ch.subject WHERE NOT odd AND chosen IS NULL AND rest AND NOT list_contains(denied, literal)
  UNION ALL SELECT ch.artifact_id, edge_id, rule_ix, slot, folded, 'otherwise' FROM ch JOIN su ON su.artifact_id = ch.artifact_id AND su.owner = ch.owner AND su.subject = ch.subject WHERE NOT odd AND chosen IS NULL AND rest
  UNION ALL SELECT q.artifact_id, edge_id, rule_ix, req_ix, CASE WHEN odd OR pa.owner IS NULL THEN q.control_id ELSE pa.folded END,
    CASE WHEN odd OR pa.owner IS NULL OR (yes IS NULL OR no IS NULL) THEN value WHEN positive THEN yes ELSE no END
  FROM q LEFT JOIN pa ON pa.artifact_id = q.artifact_id AND pa.owner = q.owner AND pa.subject = q.subject WHERE q.family = 'truth'),
sl AS (SELECT artifact_id, edge_id, rule_ix, slot, row_number() OVER (PARTITION BY artifact_id, edge_id, rule_ix ORDER BY slot) AS k FROM (
  SELECT artifact_id, edge_id, rule_ix, slot FROM ch UNION SELECT artifact_id, edge_id, rule_ix, req_ix FROM q WHERE family = 'truth')),
nx AS MATERIALIZED (SELECT al.*, sl.k FROM al JOIN sl ON sl.artifact_id = al.artifact_id AND sl.edge_id = al.edge_id AND sl.rule_ix = al.rule_ix AND sl.slot = al.slot),
mx AS (SELECT artifact_id, edge_id, rule_ix, max(k) AS n FROM sl GROUP BY ALL),
w AS (SELECT artifact_id, edge_id, rule_ix, 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS reqs FROM mx
  UNION ALL SELECT w.artifact_id, w.edge_id, w.rule_ix, nx.k, CASE WHEN list_contains(reqs, control_id || '=' || value) THEN ids ELSE list_append(ids, control_id) END,
    CASE WHEN list_contains(reqs, control_id || '=' || value) THEN reqs ELSE list_append(reqs, control_id || '=' || value) END
  FROM w JOIN nx ON nx.artifact_id = w.artifact_id AND nx.edge_id = w.edge_id AND nx.rule_ix = w.rule_ix AND nx.k = w.k + 1
  WHERE list_contains(reqs, control_id || '=' || value) OR NOT list_contains(ids, control_id))
SELECT DISTINCT w.artifact_id, w.edge_id, array_to_string(reqs, ' && ') AS rule FROM w JOIN mx ON mx.artifact_id = w.artifact_id AND mx.edge_id = w.edge_id AND mx.rule_ix = w.rule_ix AND w.k = mx.n
"""  # fmt: skip


@query("fold_conditions", "fold_requirements", sql=_FOLDED)
def fold_controls(spark, conditions, requirements):
    """Controls that conditions fold into, with the number of their cases."""
    made = folding.fold_controls(conditions, [(requirements, "edge_id")])
    n = made.cases.groupBy("artifact_id", "control_id").agg(F.count("*").alias("n_cases"))
    return made.controls.join(n, ["artifact_id", "control_id"], "left").fillna(0, ["n_cases"])


def _rules(requirements):
    rules = folding._as_rules(requirements, ["artifact_id", "edge_id", "rule_ix"])
    return rules.select("artifact_id", "edge_id", F.array_join(F.transform("rule", lambda q: F.concat(q["control_id"], F.lit("="), q["value"])), " && ").alias("rule"))


@query("fold_conditions", "fold_requirements", sql=_REWRITTEN, recursive=True)
def rewrite_requirements(spark, conditions, requirements):
    """Rules of all orders in terms of folded controls, multiplied out."""
    made = folding.fold_controls(conditions, [(requirements, "edge_id")])
    return _rules(made.rewritten(requirements, "edge_id")[0])


@query("fold_conditions", "fold_requirements", sql=_REWRITTEN.replace("SELECT DISTINCT w.artifact_id, w.edge_id, array_to_string(reqs, ' && ') AS rule", ", done AS (SELECT DISTINCT w.artifact_id, w.edge_id, len(reqs) AS n, reqs").rstrip() + """)
SELECT artifact_id, edge_id, count(*) AS n_rules, max(n) AS n_requirements, count(*) > 8 OR max(n) > 8 AS wide FROM done GROUP BY artifact_id, edge_id
UNION ALL SELECT DISTINCT r.artifact_id, r.edge_id, 0, 0, FALSE FROM fold_requirements r LEFT JOIN done ON done.artifact_id = r.artifact_id AND done.edge_id = r.edge_id WHERE done.edge_id IS NULL""", recursive=True)  # fmt: skip
def rewritten_sizes(spark, conditions, requirements):
    """Sizes of rewritten rulesets; no rules for those that can never hold."""
    made = folding.fold_controls(conditions, [(requirements, "edge_id")])
    rules, never = made.rewritten(requirements, "edge_id")
    none = never.select("artifact_id", "edge_id", F.lit(0).cast("long").alias("n_rules"), F.lit(0).cast("long").alias("n_requirements"), F.lit(False).alias("wide"))
    return folding.ruleset_sizes(rules, "edge_id").unionByName(none)
