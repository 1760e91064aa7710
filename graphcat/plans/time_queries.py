"""Queries over sequences, walkthroughs, the annotation log and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations as A
from ..operators import geometry as L
from ..operators import search as H
from ..operators import sequence as S
from ..operators import validate as V
from .catalog import query

SEQ = ("seq_messages", "seq_lifelines", "seq_branches")

_Y = """,
st AS (SELECT DISTINCT artifact_id, start_message_id AS edge_id, 1 AS s FROM seq_branches),
hd AS (SELECT artifact_id, max(height) AS header FROM seq_lifelines GROUP BY artifact_id),
i0 AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY ordinal, edge_id) - 1 AS i FROM seq_messages),
pm AS (SELECT i0.*, header + 72 * (i + 1) + 28 * coalesce(sum(CASE WHEN source_node_id = target_node_id THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + 32 * sum(coalesce(s, 0)) OVER (PARTITION BY artifact_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS y FROM i0 LEFT JOIN st USING (artifact_id, edge_id) JOIN hd USING (artifact_id)),
lx AS (SELECT *, 48 + coalesce(sum(width + 128) OVER (PARTITION BY artifact_id ORDER BY ordinal, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM seq_lifelines),
pl AS (SELECT pm.artifact_id, edge_id, i, a.x + a.width / 2 AS sx, b.x + b.width / 2 AS tx, source_node_id = target_node_id AS loop, a.width AS w, y FROM pm JOIN lx a ON a.artifact_id = pm.artifact_id AND a.node_id = source_node_id JOIN lx b ON b.artifact_id = pm.artifact_id AND b.node_id = target_node_id)
"""


@query("seq_messages", sql="SELECT artifact_id, edge_id, row_number() OVER (PARTITION BY artifact_id ORDER BY ordinal, edge_id) - 1 AS i FROM seq_messages")
def message_ordinals(spark, messages):
    return S.message_ordinals(messages).select("artifact_id", "edge_id", "i")


@query(*SEQ, sql=_Y + "SELECT artifact_id, edge_id, y FROM pm")
def message_offsets(spark, messages, lifelines, branches):
    return S.message_offsets(messages, lifelines, branches).select("artifact_id", "edge_id", "y")


@query(*SEQ, sql=_Y + "SELECT artifact_id, node_id, x FROM lx")
def lifeline_offsets(spark, messages, lifelines, branches):
    return S.lifeline_offsets(lifelines).select("artifact_id", "node_id", "x")


@query(*SEQ, "seq_activations", sql=_Y + """
SELECT a.artifact_id, node_id, activation_id, least(s.y, e.y) AS y, greatest(16, greatest(s.y, e.y) + 24 - least(s.y, e.y)) AS height
FROM seq_activations a JOIN pm s ON s.artifact_id = a.artifact_id AND s.edge_id = start_message_id JOIN pm e ON e.artifact_id = a.artifact_id AND e.edge_id = end_message_id""")  # fmt: skip
def activation_spans(spark, messages, lifelines, branches, activations):
    return S.activation_spans(activations, S.message_offsets(messages, lifelines, branches))


@query(*SEQ, sql=_Y + "SELECT artifact_id, edge_id, CASE WHEN loop THEN 4 ELSE 2 END AS n, CAST(sx AS DOUBLE) AS x1, CAST(tx AS DOUBLE) AS x2, CAST(y AS DOUBLE) AS y1, CAST(y + CASE WHEN loop THEN 28 ELSE 0 END AS DOUBLE) AS y2 FROM pl")
def message_polylines(spark, messages, lifelines, branches):
    p = S.message_polylines(S.message_offsets(messages, lifelines, branches), lifelines)
    return p.select("artifact_id", "edge_id", F.size("points").alias("n"), F.element_at("points", 1)["x"].alias("x1"), F.element_at("points", -1)["x"].alias("x2"), F.element_at("points", 1)["y"].alias("y1"), F.element_at("points", -1)["y"].alias("y2"))


@query(*SEQ, sql=_Y + "SELECT artifact_id, source_node_id AS node_id, edge_id || ':source' AS handle_id, 'right' AS side, y FROM pm UNION ALL SELECT artifact_id, target_node_id, edge_id || ':target', 'left', y + CASE WHEN source_node_id = target_node_id THEN 28 ELSE 0 END FROM pm")
def lifeline_handles(spark, messages, lifelines, branches):
    return S.lifeline_handles(S.message_offsets(messages, lifelines, branches))


_FRAG = _Y + """
, br AS (SELECT b.artifact_id, fragment_id, s.i AS si, e.i AS ei, s.y - 68 AS top, e.y + 24 AS bottom FROM seq_branches b JOIN pm s ON s.artifact_id = b.artifact_id AND s.edge_id = start_message_id JOIN pm e ON e.artifact_id = b.artifact_id AND e.edge_id = end_message_id),
xr AS (SELECT br.artifact_id, fragment_id, min(least(sx, tx)) AS l, max(greatest(sx, tx, CASE WHEN loop THEN sx + w / 2 + 64 ELSE sx END)) AS r FROM br JOIN pl ON pl.artifact_id = br.artifact_id AND i BETWEEN si AND ei GROUP BY ALL),
yr AS (SELECT artifact_id, fragment_id, min(top) AS t, max(bottom) AS b FROM br GROUP BY ALL)
"""  # fmt: skip


@query(*SEQ, sql=_FRAG + "SELECT artifact_id, fragment_id, l - 24 AS x, t AS y, r - l + 48 AS width, b - t AS height FROM xr JOIN yr USING (artifact_id, fragment_id)")
def fragment_extents(spark, messages, lifelines, branches):
    placed = S.message_offsets(messages, lifelines, branches)
    return S.fragment_extents(branches, placed, S.message_polylines(placed, lifelines))


@query("seq_messages", "seq_activations", sql="""
, m AS (SELECT artifact_id, edge_id, ordinal, source_node_id, target_node_id FROM seq_messages),
a AS (SELECT x.*, s.ordinal AS so, e.ordinal AS eo, s.target_node_id AS sn, e.source_node_id AS en FROM seq_activations x LEFT JOIN m s ON s.artifact_id = x.artifact_id AND s.edge_id = start_message_id LEFT JOIN m e ON e.artifact_id = x.artifact_id AND e.edge_id = end_message_id)
SELECT artifact_id, 'Activation ' || activation_id || ' references unknown message ' || start_message_id AS message FROM a WHERE so IS NULL
UNION ALL SELECT artifact_id, 'Activation ' || activation_id || ' references unknown message ' || end_message_id FROM a WHERE eo IS NULL
UNION ALL SELECT artifact_id, 'Activation ' || activation_id || ' startsAt does not belong to lifeline ' || node_id FROM a WHERE sn <> node_id
UNION ALL SELECT artifact_id, 'Activation ' || activation_id || ' endsAt does not belong to lifeline ' || node_id FROM a WHERE en <> node_id
UNION ALL SELECT artifact_id, 'Activation ' || activation_id || ' ends before it starts' FROM a WHERE so > eo""")  # fmt: skip
def activation_issues(spark, messages, activations):
    return V.activation_issues(activations.withColumn("ordinal", F.lit(0)), messages).select("artifact_id", "message")


@query("seq_messages", "seq_branches", sql="SELECT artifact_id, 'Fragment branch ' || branch_id || ' ends before it starts' AS message FROM seq_branches WHERE start_message_id <> end_message_id UNION ALL SELECT artifact_id, 'Fragment branch ' || branch_id || ' references unknown message gone' FROM seq_branches WHERE branch_id = 'b:0'")
def fragment_branch_issues(spark, messages, branches):
    """Branches turned round, and one in each artifact with an unknown end."""
    odd = branches.withColumns({"start_message_id": F.col("end_message_id"), "end_message_id": F.col("start_message_id"), "ordinal": F.lit(0)})
    lost = branches.filter("branch_id = 'b:0'").withColumn("end_message_id", F.lit("gone")).withColumns({"ordinal": F.lit(0), "fragment_id": F.lit("other")})
    return V.fragment_branch_issues(odd.unionByName(lost), messages).select("artifact_id", "message")


@query("seq_messages", "seq_lifelines", sql="SELECT artifact_id, 'Message edge ' || edge_id || ' target must be a lifeline' AS message FROM seq_messages WHERE target_node_id = 'user' UNION ALL SELECT artifact_id, 'Message edge ' || edge_id || ' source must be a lifeline' FROM seq_messages WHERE source_node_id = 'user'")
def message_endpoint_types(spark, messages, lifelines):
    nodes = lifelines.withColumn("type", F.when(F.col("node_id") == "user", "default").otherwise("lifeline"))
    return V.message_endpoint_types(messages.withColumn("type", F.lit("message")), nodes).select("artifact_id", "message")


@query("seq_lifelines", sql="SELECT artifact_id, 'Sequence layout requires at least one lifeline' AS message FROM seq_lifelines GROUP BY artifact_id HAVING count(*) FILTER (node_id <> 'user' AND node_id <> 'assistant') = 0")
def sequence_shape(spark, lifelines):
    nodes = lifelines.withColumn("type", F.when(F.col("node_id").isin("user", "assistant"), "fragment").otherwise("lifeline"))
    artifacts = lifelines.select("artifact_id", F.lit("sequence").alias("layout_id")).distinct()
    none = spark.createDataFrame([], "artifact_id string, group_id string")
    return V.sequence_shape(artifacts, none, nodes).select("artifact_id", "message")


@query("walk_elements", "seq_messages", "seq_lifelines", sql="""
SELECT artifact_id, step, 'Step ' || (step + 1) || ': unknown diagram ' || type || ': ' || id AS problem FROM walk_elements w WHERE type = 'group'
OR (type = 'edge' AND NOT EXISTS (SELECT 1 FROM seq_messages m WHERE m.artifact_id = w.artifact_id AND m.edge_id = w.id)) OR (type = 'node' AND NOT EXISTS (SELECT 1 FROM seq_lifelines l WHERE l.artifact_id = w.artifact_id AND l.node_id = w.id))
UNION ALL SELECT DISTINCT 'x' || artifact_id, CAST(NULL AS BIGINT), 'Walkthrough references an unknown artifact: x' || artifact_id FROM walk_elements WHERE step = 0""")  # fmt: skip
def validate_walkthroughs(spark, elements, messages, lifelines):
    known = messages.select("artifact_id").distinct()
    walks = known.union(known.select(F.concat(F.lit("x"), "artifact_id")).join(elements.filter("step = 0").select(F.concat(F.lit("x"), "artifact_id").alias("concat(x, artifact_id)")).distinct(), "concat(x, artifact_id)"))
    none = spark.createDataFrame([], "artifact_id string, group_id string")
    return V.walkthrough_problems(walks, elements, known, none, lifelines, messages)


@query("walk_elements", "seq_messages", "seq_lifelines", sql="""
, st AS (SELECT DISTINCT artifact_id, step FROM walk_elements)
SELECT l.artifact_id, st.step, 'node' AS type, l.node_id AS id, EXISTS (SELECT 1 FROM walk_elements w WHERE w.artifact_id = l.artifact_id AND w.step = st.step AND w.type IN ('node', 'group') AND w.id = l.node_id) AS emphasized FROM seq_lifelines l JOIN st USING (artifact_id)
UNION ALL SELECT m.artifact_id, st.step, 'edge', m.edge_id, EXISTS (SELECT 1 FROM walk_elements w WHERE w.artifact_id = m.artifact_id AND w.step = st.step AND w.type = 'edge' AND w.id = m.edge_id) FROM seq_messages m JOIN st USING (artifact_id)""")  # fmt: skip
def walkthrough_emphasis(spark, elements, messages, lifelines):
    own = messages.select("artifact_id", "edge_id", F.col("edge_id").alias("origin_id"))
    return H.walkthrough_emphasis(elements, lifelines, messages, own)


@query(*SEQ, "walk_elements", sql=_Y + """
SELECT w.artifact_id, step, CAST(least(sx, tx) AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(greatest(1, CASE WHEN loop THEN w.ww ELSE abs(tx - sx) END) AS DOUBLE) AS width, CAST(48 AS DOUBLE) AS height
FROM (SELECT e.artifact_id, step, id, pl.w / 2 + 64 AS ww FROM walk_elements e JOIN pl ON pl.artifact_id = e.artifact_id AND pl.edge_id = e.id WHERE e.type = 'edge') w JOIN pl ON pl.artifact_id = w.artifact_id AND pl.edge_id = w.id""")  # fmt: skip
def walkthrough_frames(spark, messages, lifelines, branches, elements):
    placed = S.message_offsets(messages, lifelines, branches)
    return H.walkthrough_frames(elements, S.message_polylines(placed, lifelines))


# the annotation log

_LOG = """,
b AS (SELECT *, op IN ('publish', 'update') AND trim(body) = '' AS blank FROM ann_log),
l AS (SELECT *, last_value(CASE WHEN op = 'publish' AND NOT blank THEN TRUE WHEN op = 'remove' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY scope_id, annotation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS alive FROM b),
r AS (SELECT *, CASE WHEN op NOT IN ('publish', 'update', 'move', 'remove') THEN 'noop' WHEN blank THEN 'blank' WHEN op <> 'publish' AND NOT coalesce(alive, FALSE) THEN 'missing' ELSE 'ok' END AS result FROM l),
e AS (SELECT scope_id, annotation_id, max(seq) FILTER (op = 'publish') AS born, max(seq) FILTER (op = 'remove') AS gone, arg_max(body, seq) FILTER (op IN ('publish', 'update')) AS body, arg_max(x, seq) FILTER (op IN ('publish', 'move')) AS x, arg_max(y, seq) FILTER (op IN ('publish', 'move')) AS y FROM r WHERE result = 'ok' GROUP BY ALL),
fin AS (SELECT scope_id, annotation_id, body, x, y FROM e WHERE born > coalesce(gone, -1))
"""


@query("ann_log", sql=_LOG + "SELECT scope_id, annotation_id, seq, result FROM r")
def annotation_results(spark, log):
    return A.annotation_results(log).select("scope_id", "annotation_id", "seq", "result")


@query("ann_log", sql=_LOG + "SELECT * FROM fin")
def fold_annotation_log(spark, log):
    return A.fold_annotation_log(log)


@query("ann_log", sql="""
, s AS (SELECT scope_id, seq, CASE WHEN seq % 13 = 0 THEN 428 WHEN trim(body) = '' THEN 422 WHEN seq % 3 = 0 THEN 409 WHEN seq % 5 = 0 THEN 412 ELSE 200 END AS st FROM ann_log)
SELECT scope_id, seq, CASE WHEN st = 200 AND row_number() OVER (PARTITION BY scope_id, st ORDER BY seq) > 1 THEN 412 ELSE st END AS status FROM s""")  # fmt: skip
def detect_save_conflicts(spark, log):
    k = F.col("seq")
    sub = log.select("scope_id", k.alias("seq"), k.alias("arrival"), F.when(k % 3 == 0, "old").otherwise("now").alias("revision_id"), F.when(k % 13 != 0, F.when(k % 5 == 0, "b").otherwise("a")).alias("expected_etag"), (F.trim("body") != "").alias("valid"))
    current = log.select("scope_id", F.lit("now").alias("revision_id"), F.lit("a").alias("etag")).distinct()
    return A.detect_save_conflicts(sub, current).select("scope_id", "seq", "status")


@query("ann_log", sql=_LOG + """
SELECT scope_id, annotation_id, CASE WHEN annotation_id = 'a:0' THEN 'deleted' WHEN x > 50 THEN 'changed' ELSE 'unchanged' END AS outcome FROM fin""")  # fmt: skip
def reconcile_edits(spark, log):
    base = A.fold_annotation_log(log)
    now = base.filter("annotation_id <> 'a:0'").withColumn("x", F.when(F.col("x") > 50, F.col("x") + 1).otherwise(F.col("x")))
    return A.reconcile_edits(base.select("scope_id", "annotation_id"), base, now).select("scope_id", "annotation_id", "outcome")


@query("ann_log", sql=_LOG + """
SELECT scope_id, annotation_id, CASE WHEN annotation_id = 'a:0' THEN 'mine' WHEN x > 50 THEN 'mine' ELSE body END AS body FROM fin WHERE annotation_id <> 'a:0' OR x > 20""")  # fmt: skip
def resolve_edit_conflicts(spark, log):
    base = A.fold_annotation_log(log)
    now = base.filter("annotation_id <> 'a:0'")
    restored = base.filter("annotation_id = 'a:0' AND x > 20").withColumns({"outcome": F.lit("deleted"), "resolution": F.lit("restore")})
    lost = base.filter("annotation_id = 'a:0' AND NOT x > 20").withColumns({"outcome": F.lit("deleted"), "resolution": F.lit("discard")})
    kept = now.filter("x > 50").withColumns({"outcome": F.lit("changed"), "resolution": F.lit("keep")})
    other = now.filter("NOT x > 50").withColumns({"outcome": F.lit("changed"), "resolution": F.lit("external")})
    edits = restored.unionByName(lost).unionByName(kept).unionByName(other).withColumn("body", F.lit("mine"))
    return A.resolve_edit_conflicts(edits, now).select("scope_id", "annotation_id", "body")


@query("ann_log", sql="SELECT scope_id, annotation_id, seq FROM ann_log WHERE seq % 4 = length(scope_id) % 4")
def active_annotations(spark, log):
    tagged = log.withColumn("catalog_revision_id", (F.col("seq") % 4).cast("string"))
    now = log.select("scope_id", (F.length("scope_id") % 4).cast("string").alias("catalog_revision_id")).distinct()
    return A.active_annotations(tagged, now).select("scope_id", "annotation_id", "seq")


@query("ann_log", sql="""
SELECT annotation_id, seq, CASE WHEN trim(coalesce(body, '')) = '' THEN 'Comment must not be blank' END AS fault FROM ann_log""")  # fmt: skip
def annotation_issues(spark, log):
    return V.annotation_issues(log).select("annotation_id", "seq", "fault")


@query("ann_log", "seq_lifelines", sql="SELECT scope_id, annotation_id, seq FROM ann_log WHERE NOT (seq % 3 = 0)")
def audit_annotation_targets(spark, log, lifelines):
    a = log.withColumns({"canvas_id": F.lit("design:a"), "target_type": F.lit("node"), "target_id": F.when(F.col("seq") % 3 == 0, "user").otherwise("nobody")})
    known = lifelines.select(F.lit("design:a").alias("canvas_id"), F.lit("node").alias("type"), F.col("node_id").alias("id")).distinct()
    return V.audit_annotation_targets(a, known).select("scope_id", "annotation_id", "seq")


@query("ann_log", sql="SELECT scope_id, annotation_id, seq FROM ann_log WHERE annotation_id = 'a:1'")
def canvas_annotations(spark, log):
    canvases = spark.createDataFrame([("a:1",)], "canvas_id string")
    return H.canvas_annotations(log.withColumn("canvas_id", F.col("annotation_id")), canvases).select("scope_id", "annotation_id", "seq")


@query("ann_log", sql="""
, k AS (SELECT scope_id, seq, CASE op WHEN 'publish' THEN 'start' WHEN 'update' THEN 'revision' ELSE 'result' END AS kind, 'o' || seq % 2 AS operation_id FROM ann_log),
c AS (SELECT *, last_value(CASE kind WHEN 'start' THEN operation_id WHEN 'revision' THEN '' END IGNORE NULLS) OVER (PARTITION BY scope_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM k)
SELECT scope_id, seq, coalesce(cur = operation_id, FALSE) AS applied FROM c WHERE kind = 'result'""")  # fmt: skip
def fence_operations(spark, log):
    kind = F.when(F.col("op") == "publish", "start").when(F.col("op") == "update", "revision").otherwise("result")
    ops = log.select("scope_id", "seq", kind.alias("kind"), F.concat(F.lit("o"), F.col("seq") % 2).alias("operation_id"))
    return A.fenced_results(ops).select("scope_id", "seq", "applied")


# search and order


@query("dep_nodes", "dep_groups", sql="SELECT q AS query, type, id, title FROM (SELECT 'node' AS type, node_id AS id, title FROM dep_nodes UNION ALL SELECT 'group', group_id, title FROM dep_groups) e, (SELECT unnest(['SUPPLIER#000000001', 'asia', 'r', '']) AS q) WHERE q <> '' AND contains(lower(title), lower(q))")
def search_elements(spark, nodes, groups):
    e = nodes.select(F.lit("dep").alias("artifact_id"), F.lit("node").alias("type"), F.col("node_id").alias("id"), "title").union(groups.select(F.lit("dep"), F.lit("group"), "group_id", "title"))
    q = spark.createDataFrame([("SUPPLIER#000000001",), ("asia",), ("r",), ("",)], "query string")
    return H.search_elements(e, q).drop("artifact_id")


@query(sql="""
SELECT DISTINCT q.n_name AS query, p.p_partkey AS id FROM part p JOIN (SELECT substr(n_name, 1, 1 + n_nationkey % 5) AS n_name FROM nation UNION SELECT substr(p_name, 2, 5) FROM part WHERE p_size = 7) q ON contains(lower(p.p_name), lower(q.n_name))""")  # fmt: skip
def search_titles(spark):
    """Titles of all parts that contain the beginning of a nation's name or a piece of another title."""
    e = spark.sql("SELECT 'parts' AS artifact_id, 'node' AS type, p_partkey AS id, p_name AS title FROM part")
    q = spark.sql("SELECT SUBSTR(n_name, 1, 1 + n_nationkey % 5) AS query FROM nation UNION SELECT SUBSTR(p_name, 2, 5) FROM part WHERE p_size = 7")
    return H.search_elements(e, q).select("query", "id")


@query(sql="SELECT p_name AS title, CAST(p_partkey AS VARCHAR) AS artifact_id FROM part ORDER BY 1, 2")
def sort_artifacts(spark):
    return H.sort_artifacts(spark.table("part").select(F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("artifact_id")))


@query(sql="""SELECT p_brand AS scope_id, arg_min(k, struct_pack(a := CASE WHEN p_size = 7 THEN 0 WHEN p_size % 2 = 0 THEN 1 ELSE 2 END, b := p_name, c := k)) AS artifact_id
FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS k, CASE WHEN p_partkey = min(p_partkey) FILTER (p_size = 7) OVER (PARTITION BY p_brand) THEN 7 ELSE CASE WHEN p_size = 7 THEN 9 ELSE p_size END END AS p_size_ FROM part) t GROUP BY p_brand""".replace("p_size = 7 THEN 0 WHEN p_size % 2", "p_size_ = 7 THEN 0 WHEN p_size_ % 2"))
def default_artifact(spark):
    p = spark.table("part")
    asked = p.filter("p_size = 7").groupBy(F.col("p_brand").alias("scope_id")).agg(F.min("p_partkey").cast("string").alias("requested"))
    kind = F.when(F.when(F.col("p_size") == 7, 9).otherwise(F.col("p_size")) % 2 == 0, "behavior").otherwise("design")
    a = p.select(F.col("p_brand").alias("scope_id"), F.col("p_partkey").cast("string").alias("artifact_id"), kind.alias("kind"), F.col("p_name").alias("title"))
    return H.default_artifact(a, asked)


@query(sql="SELECT 'g' || p_size AS id, p_name AS path, row_number() OVER (PARTITION BY p_size ORDER BY CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, p_name, p_partkey) AS place FROM part")
def rank_generators(spark):
    g = spark.table("part").select(F.concat(F.lit("g"), "p_size").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "built-in").when(F.col("p_partkey") % 3 == 1, "global").otherwise("project").alias("source"), F.concat("p_name", F.lit("\u0001"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("path"))
    return H.rank_generators(g).select("id", F.split("path", "\u0001")[0].alias("path"), "place")


@query(sql="SELECT 'project:g' || p_size AS generator, 'project' AS source, p_size % 2 = 0 AS installed, count(*) AS n FROM part GROUP BY p_size")
def generator_usage(spark):
    used = spark.table("part").select(F.concat(F.lit("project:g"), "p_size").alias("generator"))
    have = spark.table("part").filter("p_size % 2 = 0").select(F.lit("project").alias("source"), F.concat(F.lit("g"), "p_size").alias("id")).distinct()
    return H.generator_usage(used, have)


@query(sql="SELECT CAST(l_orderkey AS VARCHAR) AS scope_id, CAST(l_linenumber AS VARCHAR) AS artifact_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_artifacts(spark):
    return V.duplicate_artifacts(spark.table("lineitem").select(F.col("l_orderkey").cast("string").alias("scope_id"), F.col("l_linenumber").cast("string").alias("artifact_id")))


@query("seq_lifelines", sql="""
SELECT 's' || length(artifact_id) AS scope_id, CASE WHEN count(*) FILTER (node_id = 'system') > 0 THEN 'invalid' ELSE 'valid' END AS status, count(DISTINCT artifact_id) AS n_artifacts, count(*) FILTER (node_id = 'system') AS n_issues
FROM seq_lifelines GROUP BY 1 UNION ALL SELECT 'empty', 'missing', 0, 0""")  # fmt: skip
def catalog_status(spark, lifelines):
    a = lifelines.select(F.concat(F.lit("s"), F.length("artifact_id")).alias("scope_id"), "artifact_id").distinct()
    bad = lifelines.filter("node_id = 'system'").select("artifact_id", F.lit("nodes").alias("path"), F.lit("x").alias("message"))
    scopes = a.select("scope_id").union(spark.createDataFrame([("empty",)], "scope_id string"))
    return V.catalog_status(scopes, a, bad).drop("message")


# polylines


_INTER = """,
s AS (SELECT artifact_id, segment_id, axis, CAST(least(x1, x2) AS DOUBLE) AS l, CAST(greatest(x1, x2) AS DOUBLE) AS r, CAST(least(y1, y2) AS DOUBLE) AS t, CAST(greatest(y1, y2) AS DOUBLE) AS b FROM segments),
p AS (SELECT a.artifact_id, a.segment_id AS a, c.segment_id AS b, a.axis = c.axis AS same, a.axis AS axis, greatest(a.l, c.l) AS l, least(a.r, c.r) AS r, greatest(a.t, c.t) AS t, least(a.b, c.b) AS bb
  FROM s a JOIN s c ON a.artifact_id = c.artifact_id AND a.segment_id < c.segment_id),
h AS (SELECT *, CASE WHEN same THEN CASE WHEN axis = 'horizontal' THEN r - l ELSE bb - t END ELSE 0 END AS overlap FROM p WHERE r - l >= -0.001 AND bb - t >= -0.001),
k AS (SELECT artifact_id, a, b, CASE WHEN same THEN 'overlap' ELSE 'crossing' END AS kind, overlap, l, t FROM h WHERE NOT same OR overlap > 0.001)
"""


@query("segments", sql=_INTER + "SELECT artifact_id, a, b, kind, overlap FROM k")
def segment_interactions(spark, segs):
    return L.segment_interactions(segs).select("artifact_id", "a", "b", "kind", "overlap")


@query("segments", sql=_INTER + """
, e AS (SELECT artifact_id, a AS segment_id, kind, l, t FROM k UNION ALL SELECT artifact_id, b, kind, l, t FROM k),
c AS (SELECT artifact_id, segment_id, count(DISTINCT (round(l, 3), round(t, 3))) AS crossings FROM e WHERE kind = 'crossing' GROUP BY ALL)
SELECT artifact_id, segment_id, coalesce(crossings, 0) AS crossings FROM segments LEFT JOIN c USING (artifact_id, segment_id)""")  # fmt: skip
def segment_congestion(spark, segs):
    return L.segment_congestion(segs).select("artifact_id", "segment_id", "crossings")


@query("segments", sql="SELECT artifact_id, segment_id, CAST(abs(x2 - x1) + abs(y2 - y1) AS DOUBLE) AS length, CAST((x1 + x2) / 2.0 AS DOUBLE) AS x, CAST((y1 + y2) / 2.0 AS DOUBLE) AS y FROM segments")
def route_length_midpoint(spark, segs):
    points = segs.select("artifact_id", F.col("segment_id").alias("edge_id"), F.posexplode(F.array(F.struct(F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y")), F.struct(F.col("x2").cast("double").alias("x"), F.col("y2").cast("double").alias("y")))).alias("i", "p")).select("artifact_id", "edge_id", "i", "p.x", "p.y")
    return L.route_length(points).join(L.route_midpoint(points), ["artifact_id", "edge_id"]).withColumnRenamed("edge_id", "segment_id")


@query(*SEQ, sql=_Y + "SELECT artifact_id, edge_id, CASE WHEN loop THEN 3 ELSE 1 END AS n FROM pl")
def segments(spark, messages, lifelines, branches):
    placed = S.message_offsets(messages, lifelines, branches)
    return L.segments(S.message_polylines(placed, lifelines)).groupBy("artifact_id", "edge_id").agg(F.count("*").alias("n"))


@query("segments", sql="SELECT artifact_id, segment_id AS edge_id, 2 AS n FROM segments")
def compact_points(spark, segs):
    at = lambda t: F.struct((F.col("x1") + (F.col("x2") - F.col("x1")) * t).cast("double").alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).cast("double").alias("y"))
    points = segs.select("artifact_id", F.col("segment_id").alias("edge_id"), F.posexplode(F.array(at(0), at(0), at(0.5), at(1), at(1))).alias("i", "p")).select("artifact_id", "edge_id", "i", "p.x", "p.y")
    return L.compact_points(points).groupBy("artifact_id", "edge_id").agg(F.count("*").alias("n"))


@query("segments", sql="""
, r AS (SELECT artifact_id, segment_id AS rect_id, x1 + 3 AS l, y1 - 5 AS t, x1 + 13 AS r, y1 + 5 AS b FROM segments WHERE segment_id % 7 = 0)
SELECT artifact_id, segment_id, rect_id FROM segments s JOIN r USING (artifact_id) WHERE CASE WHEN axis = 'horizontal' THEN y1 > t AND y1 < b AND x1 < r AND x2 > l ELSE x1 > l AND x1 < r AND y1 < b AND y2 > t END""")  # fmt: skip
def obstacle_hits(spark, segs):
    rects = segs.filter("segment_id % 7 = 0").select("artifact_id", F.col("segment_id").alias("rect_id"), (F.col("x1") + 3).alias("x"), (F.col("y1") - 5).alias("y"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    return L.obstacle_hits(segs, rects).select("artifact_id", "segment_id", "rect_id")
