"""Queries that build dependency and component graphs, and their conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixpoint import discard, settled
from ..functions import exprs as X
from ..operators import components as C
from ..operators import modules as M
from ..operators import validate as V
from .catalog import query
from .fixtures import TABLES

_RANKED = """,
f AS (SELECT *, max(type_only) OVER (PARTITION BY source, specifier) AS ty FROM dep_candidates),
r AS (SELECT *, row_number() OVER (PARTITION BY source, specifier ORDER BY could_not_resolve,
  CASE WHEN ty THEN CASE pass WHEN 'types' THEN 1 WHEN 'import' THEN 2 ELSE 3 END ELSE CASE pass WHEN 'import' THEN 1 WHEN 'require' THEN 2 ELSE 3 END END) AS n FROM f),
ch AS (SELECT source, specifier, pass, resolved, could_not_resolve, type_only FROM r WHERE n = 1)
"""


@query("dep_candidates", sql=_RANKED + "SELECT * FROM ch")
def choose_dependency(spark, candidates):
    return M.choose_dependency(candidates)


# Suppliers stand for resolved files: every third was collected, every fifth is
# a package below node_modules, the rest are local modules or core.
_FACTS = _RANKED + """,
fa AS (SELECT 's/' || source AS source, 'pkg' || specifier % 50 || '/x' AS specifier, could_not_resolve, type_only,
  CASE WHEN resolved % 5 = 0 THEN 'node_modules/@s/p' || resolved || '/i.js' ELSE 'd' || resolved % 4 || '/f' || resolved END AS resolved,
  resolved % 11 = 0 AS core, resolved % 5 = 0 AS external, resolved % 2 = 0 AS boundary FROM ch),
inv AS (SELECT DISTINCT 'd' || s_suppkey % 4 || '/f' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 = 0),
tg AS (SELECT fa.source, CASE WHEN type_only THEN 'type-only' ELSE 'runtime' END AS kind,
  CASE WHEN inv.path IS NOT NULL OR (NOT external AND boundary) THEN 'local-module' ELSE 'external-package' END AS target_type,
  CASE WHEN inv.path IS NOT NULL OR (NOT external AND boundary) THEN resolved WHEN external THEN regexp_extract(resolved, 'node_modules/(@[^/]+/[^/]+)', 1) END AS target
  FROM fa LEFT JOIN inv ON inv.path = resolved WHERE NOT could_not_resolve AND NOT core)
"""


def _facts(spark, candidates):
    c = M.choose_dependency(candidates)
    file = F.concat(F.lit("d"), F.col("resolved") % 4, F.lit("/f"), "resolved")
    package = F.concat(F.lit("node_modules/@s/p"), "resolved", F.lit("/i.js"))
    facts = c.select(F.concat(F.lit("s/"), "source").alias("source"), F.concat(F.lit("pkg"), F.col("specifier") % 50, F.lit("/x")).alias("specifier"), "could_not_resolve", "type_only", F.when(F.col("resolved") % 5 == 0, package).otherwise(file).alias("resolved"), (F.col("resolved") % 11 == 0).alias("core"), (F.col("resolved") % 5 == 0).alias("external"), (F.col("resolved") % 2 == 0).alias("boundary"))
    inventory = spark.sql("SELECT DISTINCT 'd' || s_suppkey % 4 || '/f' || s_suppkey AS path FROM supplier WHERE s_suppkey % 3 = 0")
    return facts, inventory


@query("dep_candidates", sql=_FACTS + "SELECT target_type, kind, target, count(*) AS n FROM tg WHERE target IS NOT NULL GROUP BY ALL")
def classify_targets(spark, candidates):
    facts, inventory = _facts(spark, candidates)
    return M.classify_targets(facts, inventory).groupBy("target_type", "kind", "target").agg(F.count("*").alias("n"))


@query("dep_candidates", sql=_FACTS + "SELECT DISTINCT target AS path FROM tg WHERE target_type = 'local-module' AND target NOT IN (SELECT path FROM inv)")
def boundary_nodes(spark, candidates):
    facts, inventory = _facts(spark, candidates)
    return M.boundary_nodes(M.classify_targets(facts, inventory), inventory)


@query("dep_candidates", sql=_FACTS + "SELECT DISTINCT 'external:' || target AS node_id, target AS title, 'group:external-packages' AS group_id, TRUE AS synthetic FROM tg WHERE target_type = 'external-package' AND target IS NOT NULL")
def external_nodes(spark, candidates):
    return M.external_nodes(M.classify_targets(*_facts(spark, candidates)))


@query("dep_candidates", sql=_FACTS + """
SELECT DISTINCT 'dependency:' || url_encode('file:' || source) || ':' || url_encode(CASE WHEN target_type = 'local-module' THEN 'file:' ELSE 'external:' END || target) || ':' || kind AS edge_id,
  'file:' || source AS source_node_id, CASE WHEN target_type = 'local-module' THEN 'file:' ELSE 'external:' END || target AS target_node_id, kind
FROM tg WHERE target IS NOT NULL""")  # fmt: skip
def dependency_edges(spark, candidates):
    return M.dependency_edges(M.classify_targets(*_facts(spark, candidates)))


_PATHS = """,
fl AS (SELECT DISTINCT host || path AS path FROM page_paths),
mf AS (SELECT DISTINCT host AS directory, 'name:' || host AS name FROM page_paths WHERE length(host) % 2 = 0
  UNION SELECT DISTINCT host || '/' || split_part(path, '/', 2), 'name:' || split_part(path, '/', 2) FROM page_paths WHERE length(host) % 2 = 0 AND length(path) - length(replace(path, '/', '')) > 1),
"""
_NEAREST = _PATHS + """
up AS (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS directory, k FROM fl, unnest(range(1, len(string_split(path, '/')))) AS t(k)),
nr AS (SELECT path, max_by(struct_pack(d := mf.directory, n := mf.name), k) AS m FROM up JOIN mf ON mf.directory = up.directory GROUP BY path),
np AS (SELECT fl.path, coalesce(m.d, '.') AS package_root, coalesce(m.n, 'scope') AS package_name FROM fl LEFT JOIN nr USING (path))
"""  # fmt: skip


def _files(spark, pages):
    files = pages.select(F.concat("host", "path").alias("path")).distinct()
    odd = pages.filter(F.length("host") % 2 == 0)
    lang = F.split_part("path", F.lit("/"), F.lit(2))
    deep = odd.filter(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) > 1)
    manifests = odd.select(F.col("host").alias("directory"), F.concat(F.lit("name:"), "host").alias("name")).union(deep.select(F.concat_ws("/", "host", lang), F.concat(F.lit("name:"), lang))).distinct()
    return files, manifests


@query("page_paths", sql=_NEAREST + "SELECT * FROM np")
def nearest_package(spark, pages):
    return M.nearest_package(*_files(spark, pages))


@query("page_paths", sql=_NEAREST + """
, parts AS (SELECT path, package_root AS r, package_name, string_split(path, '/') AS p, CASE WHEN package_root = '.' THEN 0 ELSE len(string_split(package_root, '/')) END AS base FROM np),
gr AS (SELECT DISTINCT 'group:package:' || r AS group_id, package_name AS title, NULL AS parent_group_id FROM parts WHERE r <> '.'
  UNION SELECT DISTINCT 'group:directory:' || array_to_string(p[1:k], '/'), p[k], CASE WHEN k > base + 1 THEN 'group:directory:' || array_to_string(p[1:k - 1], '/') WHEN r <> '.' THEN 'group:package:' || r END
  FROM parts, unnest(range(base + 1, len(p))) AS t(k))
SELECT group_id, title, parent_group_id FROM gr""")  # fmt: skip
def local_grouping(spark, pages):
    return M.local_grouping(M.nearest_package(*_files(spark, pages)))[0]


@query("page_paths", sql=_NEAREST + """
SELECT 'file:' || path AS node_id, array_extract(string_split(path, '/'), -1) AS title,
  CASE WHEN len(string_split(path, '/')) - 1 > base THEN 'group:directory:' || regexp_replace(path, '/[^/]*$', '') WHEN package_root <> '.' THEN 'group:package:' || package_root END AS group_id
FROM (SELECT *, CASE WHEN package_root = '.' THEN 0 ELSE len(string_split(package_root, '/')) END AS base FROM np)""")  # fmt: skip
def build_module_graph(spark, pages):
    """Local nodes of a scope without dependencies; edges have queries of their own."""
    files, manifests = _files(spark, pages)
    none = spark.createDataFrame([], "source string, specifier string, pass string, resolved string, could_not_resolve boolean, type_only boolean, core boolean, external boolean, boundary boolean")
    _, nodes, _ = M.build_module_graph(none, files, manifests)
    return nodes.select("node_id", "title", "group_id")


@query("page_paths", sql="SELECT DISTINCT path FROM page_paths WHERE regexp_matches(path, '\\.html$') AND NOT regexp_matches(path, '^(.*/)?node_modules/')")
def source_inventory(spark, pages):
    from ..sources.artifacts import source_inventory as inventory

    return inventory(pages.select("path").distinct(), ("html",))


@query("page_paths", sql="SELECT DISTINCT path FROM page_paths WHERE NOT regexp_matches(path, '^/(.*/)?fr/') AND NOT regexp_matches(path, '^/de/') AND (NOT regexp_matches(path, '\\.html$') OR regexp_matches(path, '^/en/[^/]*\\.html$'))")
def apply_ignore_rules(spark, pages):
    return M.apply_ignore_rules(pages.select("path").distinct(), ["/fr/", "fr/", "*.html", "!/en/*.html", "de/**"])


@query("page_paths", sql="SELECT DISTINCT path, regexp_matches(path, '^/en/') OR regexp_matches(path, '^/[^/]*$') AS selected FROM page_paths")
def select_artifact_paths(spark, pages):
    return M.last_match(pages.select("path").distinct(), [("/en/**", True), ("/*", True)], "path", False)


@query(sql="SELECT 'part:' || p_partkey AS definition_id, CASE WHEN 'part:' || p_partkey LIKE 'part:7_' THEN TRUE WHEN p_brand = 'Brand#1' THEN FALSE ELSE p_partkey || '|' || p_name || '|' || p_brand LIKE '%1%' END AS visible FROM part")
def component_visibility(spark):
    d = spark.sql("SELECT 'part:' || p_partkey AS definition_id, p_name AS title, p_brand AS path FROM part")
    return C.component_visibility(d, ["*1*", "!Brand#1", "part:7?"]).select("definition_id", "visible")


@query("conditions", sql="""
SELECT owner, subject, CASE WHEN count(*) FILTER (inverted) > 0 AND count(*) FILTER (NOT inverted) > 0 THEN 'branch' ELSE 'conditional' END AS type,
  min(control_id) FILTER (NOT inverted) AS on_control, min(control_id) FILTER (inverted) AS off_control, count(*) AS n
FROM (SELECT control_id, owner, subject || literal AS subject, inverted FROM conditions) GROUP BY owner, subject""")  # fmt: skip
def fold_polarity_controls(spark, conditions):
    return C.fold_polarity_controls(conditions.withColumn("subject", F.concat("subject", "literal")))


@query("conditions", sql="""
, c AS (SELECT owner, subject, literal AS case_id, count(*) AS n, 0 AS last FROM conditions GROUP BY ALL
  UNION ALL SELECT owner, subject, 'otherwise', count(*), 1 FROM conditions WHERE inverted GROUP BY owner, subject)
SELECT owner, subject, case_id, n, row_number() OVER (PARTITION BY owner, subject ORDER BY last, case_id) - 1 AS ordinal FROM c""")  # fmt: skip
def fold_discriminants(spark, conditions):
    return C.fold_discriminants(conditions)


@query("conditions", sql="""
, c AS (SELECT DISTINCT owner, subject, literal AS case_id FROM conditions UNION SELECT owner, subject, 'otherwise' FROM conditions WHERE inverted)
SELECT control_id, count(*) AS n FROM conditions JOIN c USING (owner, subject) WHERE inverted AND case_id <> literal GROUP BY control_id""")  # fmt: skip
def expanded_negations(spark, conditions):
    return C.expanded_negations(conditions).groupBy("control_id").agg(F.count("*").alias("n"))


@query(sql="""SELECT 'n' || l_suppkey AS source, 'b' || l_partkey % 40 AS target, l_linestatus AS kind, 'slot' || l_linenumber % 2 AS slot,
  CASE WHEN bool_or(l_returnflag = 'N') THEN '' ELSE string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) END AS rules, count(DISTINCT l_quantity) AS n_suppliers, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3, 4""")  # fmt: skip
def merge_relationships(spark):
    r = spark.sql("SELECT 'n' || l_suppkey AS source, 'b' || l_partkey % 40 AS target, l_linestatus AS kind, 'slot' || l_linenumber % 2 AS slot, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS rule, l_quantity AS supplier FROM lineitem")
    return C.merge_relationships(r).select("source", "target", "kind", "slot", F.array_join("rules", ",").alias("rules"), F.size("suppliers").alias("n_suppliers"), "n")


_RELATIONS = "SELECT 'a' AS artifact_id, 'e' || l_suppkey || '-' || l_partkey AS edge_id, 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, 'slot' || min(l_linenumber) AS slot FROM lineitem GROUP BY l_suppkey, l_partkey"


@query(sql=f"""WITH e AS ({_RELATIONS}), ids AS (SELECT source_id AS node_id FROM e UNION SELECT target_id FROM e UNION SELECT 's' || s_suppkey FROM supplier),
o AS (SELECT target_id AS node_id, count(DISTINCT source_id || ':' || slot) AS n_origins FROM e GROUP BY target_id)
SELECT node_id, CASE WHEN node_id LIKE 's%' THEN 'local' WHEN CAST(substr(node_id, 2) AS BIGINT) % 3 = 0 THEN 'boundary' ELSE 'external' END AS place, coalesce(n_origins, 0) AS n_origins FROM ids LEFT JOIN o USING (node_id)""")  # fmt: skip
def assemble_component_graph(spark):
    edges = spark.sql(_RELATIONS)
    local = spark.sql("SELECT 'a' AS artifact_id, 's' || s_suppkey AS node_id FROM supplier")
    known = spark.sql("SELECT 'a' AS artifact_id, 'p' || p_partkey AS node_id FROM part WHERE p_partkey % 3 = 0")
    return C.assemble_component_graph(edges, local, known)[0].drop("artifact_id")


@query(sql="""SELECT 'from ' || coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'aux ' || s_name END, CASE WHEN s_suppkey % 3 = 0 THEN s_name END, 'outside graph') || ' (' || l_returnflag || ')' AS entry, 'p' || l_partkey AS node_id
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
UNION SELECT 'label ' || p_brand, 'p' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")  # fmt: skip
def component_origins(spark):
    nodes = spark.sql("SELECT 'a' AS artifact_id, 's' || s_suppkey AS node_id, s_name AS title FROM supplier WHERE s_suppkey % 3 = 0")
    origins = spark.sql("SELECT 'a' AS artifact_id, 'p' || l_partkey AS node_id, 's' || l_suppkey AS supplier_id, l_returnflag AS slot FROM lineitem")
    aux = spark.sql("SELECT 'a' AS artifact_id, 's' || s_suppkey AS definition_id, 'aux ' || s_name AS title FROM supplier WHERE s_suppkey % 2 = 0")
    edges = spark.sql("SELECT 'a' AS artifact_id, 'p' || p_partkey AS target_node_id, 'label ' || p_brand AS label FROM part")
    return C.component_origins(nodes, origins, aux, edges).drop("artifact_id")


@query(sql="""SELECT 'n' || c_custkey || '@0123456789abcdef' AS node_id, count(*) AS n_controls, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS controls FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def controls_by_owner(spark):
    nodes = spark.sql("SELECT 'a' AS artifact_id, 'n' || c_custkey || '@0123456789abcdef' AS node_id FROM customer")
    controls = spark.sql("SELECT 'a' AS artifact_id, 'n' || o_custkey AS owner_node_id, o_orderkey AS ordinal, CAST(o_orderkey AS STRING) AS control_id FROM orders")
    return C.controls_by_owner(nodes, controls).select("node_id", "n_controls", "controls")


@query("flow_edges", recursive=True, sql=""",
n AS (SELECT source_id AS node_id FROM flow_edges UNION SELECT target_id FROM flow_edges),
r AS (SELECT node_id FROM n WHERE CAST(node_id AS VARCHAR) LIKE '19%' UNION SELECT target_id FROM r JOIN flow_edges ON source_id = node_id)
SELECT source_id || '-' || target_id AS edge_id FROM flow_edges WHERE source_id IN (SELECT node_id FROM r) AND target_id IN (SELECT node_id FROM r)""")  # fmt: skip
def focus_on_roots(spark, edges):
    e = settled(edges.select(F.lit("flow").alias("artifact_id"), F.concat_ws("-", "source_id", "target_id").alias("edge_id"), F.col("source_id").cast("string").alias("source_node_id"), F.col("target_id").cast("string").alias("target_node_id")))
    nodes = e.select("artifact_id", F.explode(F.array("source_node_id", "target_node_id")).alias("node_id")).distinct().withColumn("title", F.lit(None).cast("string"))
    return C.focus_on_roots(nodes, e, ["19*"])[1].select("edge_id")


@query("flow_edges", recursive=True, sql=""",
e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM flow_edges), known AS (SELECT DISTINCT s AS c FROM e WHERE s % 11 <> 0),
fwd AS (SELECT s, CASE WHEN s % 3 = 0 THEN NULL WHEN t % 2 = 0 THEN 'children' ELSE 'onClick' END AS prop, t, CASE WHEN t % 5 = 0 THEN 'onSelect' ELSE 'children' END AS to_prop, CASE WHEN s % 2 = 0 THEN 'onClick' ELSE 'key' END AS excluded FROM e JOIN known ON c = s),
r AS (SELECT 'v:' || (s % 10) AS v, CASE WHEN s % 2 = 0 THEN 'slot' ELSE 'render-prop' END AS k, s AS c, CASE WHEN s % 4 = 1 THEN 'onClick' ELSE 'children' END AS p FROM e
  UNION SELECT r.v, r.k, f.t, coalesce(CASE WHEN f.prop IS NOT NULL THEN f.to_prop END, r.p) FROM r JOIN fwd f ON f.s = r.c AND (f.prop = r.p OR f.prop IS NULL AND f.excluded <> r.p)),
ends AS (SELECT DISTINCT r.* FROM r JOIN known ON known.c = r.c WHERE r.p = 'children' AND r.c % 7 = 0 AND r.k = CASE WHEN r.c % 2 = 0 THEN 'slot' ELSE 'render-prop' END
  UNION SELECT * FROM r WHERE c NOT IN (SELECT c FROM known) AND NOT (k = 'render-prop' AND regexp_matches(p, '^on[A-Z]')))
SELECT v AS value_id, k AS value_kind, c AS component, p AS prop FROM ends""")  # fmt: skip
def consumer_routes(spark, edges):
    """Ten values of two kinds, each supplied to a tenth of the parts, forwarded along edges
    under names or as a whole, to parts that render, are not analysed or lead nowhere."""
    edges = settled(edges)
    of = lambda c: edges.select(F.col("source_id").alias("component"), "target_id").distinct().filter(c)
    s, t = F.col("component"), F.col("target_id")
    supplied = of("true").select(F.concat_ws(":", F.lit("v"), s % 10).alias("value_id"), F.when(s % 2 == 0, "slot").otherwise("render-prop").alias("value_kind"), "component", F.when(s % 4 == 1, "onClick").otherwise("children").alias("prop")).distinct()
    prop = F.when(s % 3 == 0, "*").when(t % 2 == 0, "children").otherwise("onClick")
    forward = of("true").select("component", prop.alias("prop"), F.lit("forward").alias("kind"), t.alias("to_component"), F.when(t % 5 == 0, "onSelect").otherwise("children").alias("to_prop"), F.array(F.when(s % 2 == 0, "onClick").otherwise("key")).alias("excluded"))
    render = of("component % 7 = 0").select("component", F.lit("children").alias("prop"), F.lit("render").alias("kind"), F.when(s % 2 == 0, "slot").otherwise("render-prop").alias("value_kind")).distinct()
    return C.consumer_routes(supplied, forward.unionByName(render, allowMissingColumns=True), of("component % 11 <> 0").select("component")).select("value_id", "value_kind", "component", "prop")


@query("dep_groups", recursive=True, sql=""",
u AS (SELECT parent_group_id AS p, group_id AS c FROM dep_groups WHERE parent_group_id IS NOT NULL UNION ALL SELECT 'nation:3', 'world'),
t AS (SELECT 'world' AS d, 0 AS depth, ['world'] AS above, FALSE AS closed UNION ALL SELECT c, depth + 1, list_append(above, c), list_contains(above, c) FROM t JOIN u ON p = d WHERE NOT closed)
SELECT d AS definition_id, depth, closed, count(*) AS n FROM t GROUP BY ALL""")  # fmt: skip
def expand_instances(spark, groups):
    uses = groups.filter("parent_group_id IS NOT NULL").select(F.concat("parent_group_id", F.lit(">"), "group_id").alias("use_id"), F.col("parent_group_id").alias("parent_definition"), F.col("group_id").alias("definition_id"))
    ring = spark.createDataFrame([("nation:3>world", "nation:3", "world")], uses.schema)
    roots = spark.createDataFrame([("world",)], "definition_id string")
    return C.expand_instances(uses.union(ring), roots).groupBy("definition_id", "depth", "closed").agg(F.count("*").alias("n"))


TABLES["shop_uses"] = """
SELECT 'shop' AS parent_definition, 'region:' || CAST(r_regionkey AS STRING) AS definition_id, r_regionkey AS ordinal, FALSE AS hidden FROM region
UNION ALL SELECT 'region:' || CAST(n_regionkey AS STRING), 'nation:' || CAST(n_nationkey AS STRING), n_nationkey, n_nationkey % 3 = 0 FROM nation
UNION ALL SELECT 'nation:' || CAST(c_nationkey AS STRING), 'customer:' || CAST(c_custkey AS STRING), c_custkey, c_custkey % 3 = 1 FROM customer
UNION ALL SELECT 'customer:' || CAST(o_custkey AS STRING), 'order:' || CAST(o_orderkey AS STRING), o_orderkey, o_orderkey % 3 = 2 FROM orders
UNION ALL SELECT DISTINCT 'order:' || CAST(l_orderkey AS STRING), 'flag:' || l_returnflag, ASCII(l_returnflag), FALSE FROM lineitem
UNION ALL SELECT DISTINCT 'flag:' || l_returnflag, 'line:' || l_linestatus, ASCII(l_linestatus), l_linestatus = 'F' FROM lineitem
"""


@query("shop_uses", recursive=True, sql=""",
t AS (SELECT 'shop' AS d, FALSE AS hidden, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS BIGINT[]) AS parent_way, CAST([] AS BIGINT[]) AS way
  UNION ALL SELECT u.definition_id, u.hidden, CASE WHEN t.hidden THEN t.parent ELSE t.d END, CASE WHEN t.hidden THEN t.parent_way ELSE t.way END, list_append(t.way, CAST(u.ordinal AS BIGINT)) FROM t JOIN shop_uses u ON u.parent_definition = t.d)
SELECT d AS definition_id, parent AS parent_definition, row_number() OVER (PARTITION BY parent_way ORDER BY way) - 1 AS ordinal, len(way) AS depth FROM t WHERE NOT hidden""")  # fmt: skip
def visible_instances(spark, uses):
    """Instances of all orders with a third of the definitions hidden."""
    uses = settled(uses)
    named = uses.withColumn("use_id", F.concat_ws(">", "parent_definition", "definition_id"))
    roots = spark.createDataFrame([("shop",)], "definition_id string")
    instances = C.expand_instances(named, roots)
    shown = C.visible_instances(instances, uses.filter("hidden").select("definition_id"))
    made = settled(shown.select("instance_id", "parent_id", "definition_id", "ordinal", "depth"))
    discard(instances, shown)
    above = made.select(F.col("instance_id").alias("parent_id"), F.col("definition_id").alias("parent_definition"))
    return made.join(above, "parent_id", "left").select("definition_id", "parent_definition", "ordinal", "depth")


@query("flow_edges", recursive=True, sql=""",
w AS (SELECT source_id AS a, target_id AS b FROM flow_edges UNION SELECT w.a, e.target_id FROM w JOIN flow_edges e ON e.source_id = w.b)
SELECT DISTINCT 'control_cycles' AS code, 'Component control prerequisites contain a cycle' AS message FROM w WHERE a = b""")  # fmt: skip
def control_cycles(spark, edges):
    p = edges.select(F.lit("flow").alias("artifact_id"), F.col("source_id").alias("control_id"), F.col("target_id").alias("req_control_id"))
    return V.control_cycles(p).select("code", "message")


# column expressions over whole tables


@query("page_paths", sql="SELECT page_id, 'source:///' || replace(url_encode(substr(path, 2)), '%2F', '/') AS href FROM page_paths WHERE path <> ''")
def source_href(spark, pages):
    return pages.filter("path <> ''").select("page_id", X.source_href(F.substr("path", F.lit(2))).alias("href"))


@query("page_paths", sql="""
, h AS (SELECT page_id, page_id % 7 AS k, href, CASE WHEN page_id % 7 = 0 OR (page_id % 7 NOT IN (4, 5) AND regexp_matches(href, '^[^#]*[?]')) THEN 'scheme' WHEN page_id % 7 = 4 THEN 'outside' WHEN page_id % 7 = 5 THEN 'url'
  WHEN contains(href, '#') OR page_id % 7 = 3 THEN 'fragment' WHEN page_id % 7 = 2 THEN 'range' END AS error FROM page_paths)
SELECT page_id, CASE WHEN error IS NULL THEN substr(href, 11) END AS path, CASE WHEN error IS NULL THEN CASE k WHEN 1 THEN 12 WHEN 6 THEN 3 END END AS line, CASE WHEN error IS NULL AND k = 6 THEN 9 END AS end_line, error FROM h""")  # fmt: skip
def parse_source_href(spark, pages):
    k = F.col("page_id") % 7
    h = F.when(k == 0, F.replace("href", F.lit("source"), F.lit("http"))).when(k == 1, F.concat("href", F.lit("#L12"))).when(k == 2, F.concat("href", F.lit("#L12-L7"))).when(k == 3, F.concat("href", F.lit("#x"))).when(k == 4, F.lit("source:///../a")).when(k == 5, F.lit("nothing")).otherwise(F.concat("href", F.lit("#L3-9")))
    return pages.select("page_id", X.parse_source_href(h).alias("p")).select("page_id", "p.*")


@query("page_links", sql="SELECT page_id, h AS href, CASE WHEN length(h) % 3 = 0 THEN 'text' ELSE h END AS label, 'page' AS kind FROM page_links, unnest(hrefs) AS t(h)")
def link_inventory(spark, links):
    each = links.select("page_id", F.explode("hrefs").alias("href"))
    return each.select("page_id", "href", X.link_label(F.when(F.length("href") % 3 == 0, "text"), "href").alias("label"), F.lit("page").alias("kind"))


@query("page_paths", sql="""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'p' || page_id WHEN 1 THEN '@s/p' || page_id WHEN 2 THEN 'bare' ELSE NULL END AS package FROM page_paths""")
def package_name(spark, pages):
    k = F.col("page_id") % 4
    resolved = F.when(k == 0, F.concat(F.lit("a/node_modules/x/node_modules/p"), "page_id", F.lit("/i.js"))).when(k == 1, F.concat(F.lit("node_modules/@s/p"), "page_id", F.lit("/i.js"))).otherwise(F.col("path"))
    return pages.select("page_id", X.package_name(F.when(k == 2, "bare/x").otherwise("./x"), resolved).alias("package"))


@query("page_paths", sql="SELECT page_id, regexp_replace(host || path, '/?[^/]*$', '') AS parent, starts_with(path || '/', '/en/') AS inside FROM page_paths")
def parent_path(spark, pages):
    return pages.select("page_id", X.parent_path(F.concat("host", "path")).alias("parent"), X.is_path_inside(F.lit("/en"), "path").alias("inside"))


@query("page_paths", sql="""SELECT page_id, regexp_matches(path, '^[^/]+(/[^/]+)*\\.json$') AS id_ok, page_id % 3 = 0 AS generator_ok, page_id % 5 <> 0 AS revision_ok, page_id % 4 = 0 AS time_ok FROM page_paths""")
def validity_predicates(spark, pages):
    k = F.col("page_id")
    return pages.select("page_id", X.artifact_id_valid("path").alias("id_ok"), X.generator_ref_valid(F.when(k % 3 == 0, "project:a-b").when(k % 3 == 1, "other:a").otherwise("global:A")).alias("generator_ok"), X.revision_id_valid(F.when(k % 5 == 0, "sha256:x").otherwise(F.concat(F.lit("sha256:"), F.sha2("path", 256)))).alias("revision_ok"), X.utc_datetime_valid(F.when(k % 4 == 0, "2024-02-29T10:00:00.5Z").when(k % 4 == 1, "2023-02-29T10:00:00Z").when(k % 4 == 2, "2024-01-01").otherwise("2024-01-01T10:00:00+01:00")).alias("time_ok"))


@query("dep_edges", sql="SELECT source_node_id, target_node_id, kind, md5(source_node_id) IS NOT NULL AS ok, substr(sha256(source_node_id || chr(1) || target_node_id), 1, 16) AS id FROM dep_edges")
def stable_ids(spark, edges):
    return edges.select("source_node_id", "target_node_id", "kind", F.lit(True).alias("ok"), X.hashed_id("source_node_id", "target_node_id").alias("id"))


@query(sql="SELECT p_partkey, 'p' || p_partkey AS definition_id FROM part")
def to_definition_id(spark):
    return spark.table("part").select("p_partkey", X.to_definition_id(F.concat(F.lit("p"), "p_partkey", F.lit("@0123456789abcdef"))).alias("definition_id"))


@query(sql="""SELECT 'user:' || user_id AS scope_id, event_id, '"sha256:' || sha256('r' || user_id || chr(10) || props) || '"' AS etag, CASE WHEN event_id % 2 = 0 THEN 'behavior:' ELSE 'design:' END || event_id AS canvas FROM events""")
def annotation_etag(spark):
    return spark.table("events").select(F.concat(F.lit("user:"), "user_id").alias("scope_id"), "event_id", X.annotation_etag(F.concat(F.lit("r"), "user_id"), "props").alias("etag"), X.canvas_id(F.when(F.col("event_id") % 2 == 0, "sequence").otherwise("general"), F.col("event_id").cast("string")).alias("canvas"))


@query("seq_messages", sql="SELECT artifact_id, edge_id, CASE WHEN message_type = 'return' THEN NULL ELSE message_type END AS kind FROM seq_messages")
def edge_display(spark, messages):
    return messages.select("artifact_id", "edge_id", X.edge_display(F.when(F.col("message_type") == "return", "control").otherwise("message"), "message_type").alias("kind"))
