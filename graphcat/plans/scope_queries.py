"""Queries on modules of several scopes at once, and on ignore rules kept as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modules as M
from .catalog import query
from .fixtures import TABLES

# Two scopes by line status, in which the same orders import and the same files are resolved.
TABLES["scoped_candidates"] = """
SELECT l_linestatus AS scope_id, 's' || CAST(l_orderkey % 7 AS STRING) || '/o' || CAST(l_orderkey AS STRING) AS source, 'pkg' || CAST(l_partkey % 50 AS STRING) || '/x' AS specifier,
  CASE l_returnflag WHEN 'A' THEN 'import' WHEN 'N' THEN 'require' ELSE 'types' END AS pass,
  CASE WHEN MIN(l_suppkey) % 5 = 0 THEN 'node_modules/@s/p' || CAST(MIN(l_suppkey) AS STRING) || '/i.js' ELSE 'd' || CAST(MIN(l_suppkey) % 4 AS STRING) || '/f' || CAST(MIN(l_suppkey) AS STRING) END AS resolved,
  MIN(l_quantity) > 45 AS could_not_resolve, MAX(l_discount) > 0.08 AS type_only, MIN(l_suppkey) % 11 = 0 AS core, MIN(l_suppkey) % 5 = 0 AS external, MIN(l_suppkey) % 2 = 0 AS boundary
FROM lineitem GROUP BY 1, 2, 3, 4
"""
TABLES["scoped_files"] = """
SELECT DISTINCT l_linestatus AS scope_id, 's' || CAST(l_orderkey % 7 AS STRING) || '/o' || CAST(l_orderkey AS STRING) AS path FROM lineitem
UNION SELECT s.scope_id, 'd' || CAST(s_suppkey % 4 AS STRING) || '/f' || CAST(s_suppkey AS STRING)
FROM supplier JOIN (SELECT 'F' AS scope_id, 0 AS r UNION ALL SELECT 'O', 1) s ON s_suppkey % 3 = s.r
"""
TABLES["scoped_manifests"] = """
SELECT 'F' AS scope_id, 's' || CAST(s_suppkey % 3 AS STRING) AS directory, 'pack' || CAST(s_suppkey % 3 AS STRING) AS name FROM supplier UNION SELECT 'O', 'd' || CAST(s_suppkey % 2 AS STRING), 'data' FROM supplier
"""

_TARGETS = """,
f AS (SELECT *, max(type_only) OVER (PARTITION BY scope_id, source, specifier) AS ty FROM scoped_candidates),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, source, specifier ORDER BY could_not_resolve,
  CASE WHEN ty THEN CASE pass WHEN 'types' THEN 1 WHEN 'import' THEN 2 ELSE 3 END ELSE CASE pass WHEN 'import' THEN 1 WHEN 'require' THEN 2 ELSE 3 END END) AS n FROM f),
tg AS (SELECT r.scope_id, r.source, CASE WHEN type_only THEN 'type-only' ELSE 'runtime' END AS kind, i.path IS NOT NULL OR (NOT external AND boundary) AS local,
  CASE WHEN i.path IS NOT NULL OR (NOT external AND boundary) THEN resolved WHEN external THEN regexp_extract(resolved, 'node_modules/(@[^/]+/[^/]+)', 1) END AS target
  FROM r LEFT JOIN scoped_files i ON i.scope_id = r.scope_id AND i.path = r.resolved WHERE n = 1 AND NOT could_not_resolve AND NOT core)
"""


@query("scoped_candidates", "scoped_files", "scoped_manifests", sql=_TARGETS + """
SELECT DISTINCT scope_id, 'dependency:' || url_encode('file:' || source) || ':' || url_encode(CASE WHEN local THEN 'file:' ELSE 'external:' END || target) || ':' || kind AS edge_id,
  'file:' || source AS source_node_id, CASE WHEN local THEN 'file:' ELSE 'external:' END || target AS target_node_id, kind FROM tg WHERE target IS NOT NULL""")  # fmt: skip
def module_graph_edges(spark, candidates, files, manifests):
    return M.build_module_graph(candidates, files, manifests)[2]


@query("scoped_candidates", "scoped_files", "scoped_manifests", sql=_TARGETS + """,
fl AS (SELECT scope_id, path, FALSE AS outside FROM scoped_files UNION SELECT t.scope_id, t.target, TRUE FROM tg t LEFT JOIN scoped_files i ON i.scope_id = t.scope_id AND i.path = t.target WHERE local AND i.path IS NULL),
pk AS (SELECT fl.*, split_part(path, '/', 1) AS d, m.name FROM fl LEFT JOIN scoped_manifests m ON m.scope_id = fl.scope_id AND m.directory = split_part(path, '/', 1))
SELECT scope_id, 'file:' || path AS node_id, split_part(path, '/', 2) AS title, CASE WHEN name IS NULL THEN 'group:directory:' ELSE 'group:package:' END || d AS group_id, outside FROM pk
UNION ALL SELECT DISTINCT scope_id, 'external:' || target, target, 'group:external-packages', NULL::BOOLEAN FROM tg WHERE NOT local AND target IS NOT NULL""")  # fmt: skip
def module_graph_nodes(spark, candidates, files, manifests):
    return M.build_module_graph(candidates, files, manifests)[1].select("scope_id", "node_id", "title", "group_id", "outside")


@query("scoped_candidates", "scoped_files", "scoped_manifests", sql=_TARGETS + """,
fl AS (SELECT scope_id, split_part(path, '/', 1) AS d FROM scoped_files UNION SELECT scope_id, split_part(target, '/', 1) FROM tg WHERE local)
SELECT DISTINCT fl.scope_id, CASE WHEN m.name IS NULL THEN 'group:directory:' ELSE 'group:package:' END || d AS group_id, coalesce(m.name, d) AS title, FALSE AS synthetic
FROM fl LEFT JOIN scoped_manifests m ON m.scope_id = fl.scope_id AND m.directory = d
UNION ALL SELECT DISTINCT scope_id, 'group:external-packages', 'External packages', TRUE FROM tg WHERE NOT local AND target IS NOT NULL""")  # fmt: skip
def module_graph_groups(spark, candidates, files, manifests):
    return M.build_module_graph(candidates, files, manifests)[0].select("scope_id", "group_id", "title", "synthetic")


# The ignore files of each host: its top, and two directories with opposite rules. The
# fourth column is what the pattern stands for.
_RULES = [
    ("", 0, "*3.html", r"^(.*/)?[^/]*3\.html/?$"),
    ("", 1, "# a comment", None),
    ("", 2, "de/", r"^(.*/)?de/$"),
    ("en", 0, "*.html", r"^(.*/)?[^/]*\.html/?$"),
    ("en", 2, "!*1.html", r"^(.*/)?[^/]*1\.html/?$"),
    ("fr", 0, "!*3.html", r"^(.*/)?[^/]*3\.html/?$"),
    ("fr", 1, "/fr/**/?7.html", r"^fr/(.*/)?[^/]7\.html/?$"),
    ("de", 0, "!*", r"^(.*/)?[^/]*/?$"),
    (None, 0, "*99.html", r"^(.*/)?[^/]*99\.html/?$"),
]
_VALUES = ", ".join(f"({'NULL' if d is None else repr(d)}, {o}, '{r}', {'FALSE' if p.startswith('!') else 'TRUE'})" for d, o, p, r in _RULES if r)


@query("page_paths", recursive=False, sql=f""",
p AS (SELECT DISTINCT host AS scope_id, substr(path, 2) AS path, string_split(substr(path, 2), '/') AS s FROM page_paths WHERE length(path) > 1),
ru AS (SELECT * FROM (VALUES {_VALUES}) t(directory, ordinal, regex, ignores)),
q AS (SELECT DISTINCT scope_id, array_to_string(s[1:k], '/') AS entry, s[1:k] AS es, k < len(s) AS is_dir FROM p, unnest(range(1, len(s) + 1)) AS t(k)),
te AS (SELECT scope_id, entry, es, array_to_string(es[1:k], '/') || CASE WHEN k < len(es) OR is_dir THEN '/' ELSE '' END AS test FROM q, unnest(range(1, len(es) + 1)) AS t(k)),
m AS (SELECT te.scope_id, te.entry, te.test, ru.ignores, CASE WHEN ru.directory IS NULL THEN 1000 WHEN ru.directory = '' THEN 0 ELSE 1 END * 100 + ru.ordinal AS pl FROM te JOIN ru
  ON (ru.directory IS NULL OR ru.directory = '' OR (starts_with(te.entry, ru.directory || '/'))) AND regexp_matches(te.test, ru.regex)),
ig AS (SELECT DISTINCT scope_id, entry FROM (SELECT scope_id, entry, test, max_by(ignores, pl) AS i FROM m GROUP BY ALL) x WHERE i),
bl AS (SELECT DISTINCT p.scope_id, p.path FROM p, unnest(range(1, len(p.s) + 1)) AS t(k) JOIN ig ON ig.scope_id = p.scope_id AND ig.entry = array_to_string(p.s[1:k], '/'))
SELECT p.scope_id, p.path FROM p LEFT JOIN bl ON bl.scope_id = p.scope_id AND bl.path = p.path WHERE bl.path IS NULL""")  # fmt: skip
def apply_directory_rules(spark, pages):
    paths = pages.filter("length(path) > 1").select(F.col("host").alias("scope_id"), F.substr("path", F.lit(2)).alias("path")).distinct()
    rules = spark.createDataFrame([(d, o, p) for d, o, p, r in _RULES if r or p.startswith("#")], "directory string, ordinal int, pattern string")
    return M.apply_directory_rules(paths, paths.select("scope_id").distinct().join(F.broadcast(rules), F.lit(True)))
