"""Queries of stores, manifests, contracts and links over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixpoint import shared_folder
from ..operators import search, validate
from ..sources import stores
from .catalog import query


@query(sql="""
WITH a AS (SELECT split_part(url, '/', 3) AS scope_id, sha256(length(CAST(page_id AS VARCHAR)) || ':' || page_id || length(url) || ':' || url || coalesce(length(html) || ':' || html, '-')) AS d FROM pages),
g AS (SELECT scope_id, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM a GROUP BY scope_id, left(d, 3))
SELECT scope_id, sha256(string_agg(d, chr(10) ORDER BY d)) AS catalog_revision_id FROM g GROUP BY scope_id""")  # fmt: skip
def catalog_revision_id(spark):
    pages = spark.table("pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("scope_id"), F.col("page_id").cast("string").alias("artifact_id"), "url", "html")
    return stores.catalog_revisions(pages, "url", "html")


def _stored(rows, revision):
    return rows.select("scope_id", F.lit(revision).alias("catalog_revision_id"), "annotation_id", "body")


@query("ann_log", sql="""
, l AS (SELECT scope_id, annotation_id, arg_max(body, seq) AS body FROM ann_log GROUP BY ALL),
s AS (SELECT scope_id, 'r1' AS catalog_revision_id, annotation_id, body FROM l WHERE annotation_id <> 'a:1' UNION ALL SELECT scope_id, 'r2', annotation_id, body FROM l),
r AS (SELECT DISTINCT scope_id, unnest(['r1', 'r2', 'r3']) AS catalog_revision_id FROM ann_log)
SELECT scope_id, catalog_revision_id, annotation_id, body FROM r LEFT JOIN s USING (scope_id, catalog_revision_id)""")  # fmt: skip
def read_annotations(spark, log):
    """Two revisions, one of them written twice, read back, and one without any."""
    last = log.groupBy("scope_id", "annotation_id").agg(F.max_by("body", "seq").alias("body"))
    path = shared_folder(spark)
    stores.write_annotations(_stored(last, "r1"), path)
    stores.write_annotations(_stored(last, "r2"), path)
    stores.write_annotations(_stored(last.filter("annotation_id <> 'a:1' OR scope_id IS NULL"), "r1"), path)
    revisions = log.select("scope_id").distinct().select("scope_id", F.explode(F.array(*map(F.lit, ("r1", "r2", "r3")))).alias("catalog_revision_id"))
    return stores.read_annotations(spark, path, revisions, _stored(last, "r1").schema)


@query(sql="""
SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN k IN (0, 1) THEN 'g-' || doc_id END AS id, CASE WHEN k IN (0, 1) THEN 'of ' || source || ': ' || coalesce(lang, '') END AS description, CASE WHEN k IN (0, 1) THEN 'Say ' || doc_id || chr(10) || '---' END AS prompt,
CASE k WHEN 2 THEN 'Missing opening frontmatter delimiter' WHEN 3 THEN 'Missing closing frontmatter delimiter' WHEN 4 THEN 'Malformed frontmatter line: :no key' WHEN 5 THEN 'Unknown frontmatter key: lang' WHEN 6 THEN 'Duplicate frontmatter key: id' WHEN 7 THEN 'Missing id' WHEN 8 THEN 'Missing description' WHEN 9 THEN 'Missing prompt' WHEN 10 THEN 'Invalid id: G_' || doc_id END AS error
FROM (SELECT *, doc_id % 11 AS k FROM documents)""")  # fmt: skip
def read_generators(spark):
    """A manifest for each document, faulty in ten ways by its id."""
    k = F.col("doc_id") % 11
    case = lambda n, a, b: F.when(k == n, a).otherwise(b)
    text = F.concat(
        case(2, F.lit("id: x\n"), F.lit("---\n")),
        case(7, F.lit("id:  \n"), F.concat(F.lit("id: "), case(10, F.lit("G_"), F.lit("g-")), "doc_id", F.lit("\n\n"))),
        case(4, F.lit(":no key\n"), F.lit("")),
        case(5, F.lit("lang: en\n"), F.lit("")),
        case(6, F.lit("id: twice\n"), F.lit("")),
        case(8, F.lit(""), F.concat(F.lit(" description :  of "), "source", F.lit(": "), F.coalesce("lang", F.lit("")), F.lit("\n"))),
        case(3, F.lit("-- -\n"), F.lit("---\n")),
        case(9, F.lit(" \n "), F.concat(F.lit("\nSay "), "doc_id", case(3, F.lit(""), F.lit("\n---\n")))),
    )
    text = F.when(k == 1, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    return stores.parse_manifests(spark.table("documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("raw")))


@query("dep_candidates", sql="SELECT CAST(source AS VARCHAR) AS source, CAST(specifier AS VARCHAR) AS specifier, pass, CAST(resolved AS VARCHAR) AS resolved, could_not_resolve, type_only FROM dep_candidates")
def read_dependency_candidates(spark, candidates):
    path = shared_folder(spark)
    candidates.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(stores.CANDIDATE))).write.json(path)
    return stores.read_dependency_candidates(spark, path)


@query("dep_groups", "dep_edges", sql="""
SELECT 'definitions' AS name, count(*) AS n, count(DISTINCT group_id) AS keys FROM dep_groups
UNION ALL SELECT 'uses', count(*), count(DISTINCT parent_group_id) FROM dep_groups WHERE parent_group_id IS NOT NULL
UNION ALL SELECT 'supplied', count(*), count(DISTINCT source_node_id) FROM dep_edges
UNION ALL SELECT 'consumers', count(*), count(DISTINCT target_node_id) FROM (SELECT DISTINCT target_node_id, kind FROM dep_edges)""")  # fmt: skip
def read_component_facts(spark, groups, edges):
    path, none = shared_folder(spark), F.lit(None).cast(stores.RULES)
    made = {
        "definitions": groups.select(F.col("group_id").alias("definition_id"), F.col("title").alias("name")),
        "uses": groups.filter("parent_group_id IS NOT NULL").select(F.concat("parent_group_id", F.lit(">"), "group_id").alias("use_id"), F.col("parent_group_id").alias("parent_definition"), F.col("group_id").alias("definition_id"), none.alias("ruleset")),
        "supplied": edges.select(F.concat_ws(">", "source_node_id", "target_node_id", "kind").alias("value_id"), F.col("source_node_id").alias("use_id"), F.lit("children").alias("prop"), "kind"),
        "consumers": edges.select(F.col("target_node_id").alias("component"), F.lit("children").alias("prop"), "kind").distinct(),
    }
    for name, rows in made.items():
        rows.write.json(f"{path}/{name}")
    keys = {"definitions": "definition_id", "uses": "parent_definition", "supplied": "use_id", "consumers": "component"}
    out = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.count_distinct(keys[name]).alias("keys")).select("name", "n", "keys") for name, df in stores.read_component_facts(spark, path).items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("page_paths", sql="""
, l AS (SELECT page_id, page_id % 7 AS k, regexp_replace(substr(href, 11), '[?#].*$', '') AS p FROM page_paths),
f AS (SELECT p, min(page_id) AS low FROM l WHERE k <> 1 GROUP BY p)
SELECT page_id, CASE WHEN k = 0 THEN 400 WHEN low IS NULL THEN 404 WHEN low % 3 = 0 THEN 403 WHEN low % 3 = 1 THEN 422 ELSE 200 END AS status,
CASE WHEN k = 0 THEN 'Source href is invalid: scheme' WHEN low IS NULL THEN 'Source file does not exist: ' || l.p WHEN low % 3 = 0 THEN 'Source path resolves outside the review scope.' WHEN low % 3 = 1 THEN 'Source path is not a file: ' || l.p END AS message
FROM l LEFT JOIN f USING (p)""")  # fmt: skip
def audit_links(spark, pages):
    """A link to each page's path, against what six in seven of them resolve to."""
    plain = pages.withColumn("href", F.regexp_replace("href", "[?#].*$", ""))
    path = F.substr("href", F.lit(11))
    inventory = plain.filter("page_id % 7 <> 1").groupBy(path.alias("source_path")).agg(F.min("page_id").alias("low"))
    inventory = inventory.select("source_path", (F.col("low") % 3 != 0).alias("inside"), (F.col("low") % 3 != 1).alias("is_file"))
    links = plain.select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("https:///"), path)).otherwise(F.concat(F.lit("source:///"), path)).alias("href"))
    return stores.audit_links(links, inventory).select("page_id", "status", "message")


@query("seq_lifelines", sql="""
, a AS (SELECT DISTINCT artifact_id FROM seq_lifelines),
l AS (SELECT CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'lost:' || conv_id ELSE 'conv:' || conv_id END AS artifact_id FROM conversations)
SELECT l.artifact_id, count(a.artifact_id) AS n_ok, count(*) FILTER (WHERE l.artifact_id IS NOT NULL AND a.artifact_id IS NULL) AS n_invalid, count(*) FILTER (WHERE l.artifact_id IS NULL) AS n_undecodable
FROM l LEFT JOIN a ON a.artifact_id = l.artifact_id GROUP BY l.artifact_id""")  # fmt: skip
def audit_shared_walkthroughs(spark, lifelines):
    """A link for each turn of a conversation; every fifth conversation's links
    are padded, hence not canonical, and those of others name no artifact."""
    k = F.col("conv_id") % 5
    walk = F.to_json(F.struct(F.concat(F.when(k == 1, "lost:").otherwise("conv:"), "conv_id").alias("artifactId"), F.array(F.struct(F.concat(F.lit("turn "), "turn").alias("caption"))).alias("steps")))
    text = F.regexp_replace(F.translate(F.regexp_replace(F.base64(walk.cast("binary")), "[\r\n]", ""), "+/", "-_"), "=+$", "")
    links = spark.table("conversations").select(F.when(k == 0, F.concat(text, F.lit("="))).otherwise(text).alias("parameter"))
    return search.audit_shared_walkthroughs(links, lifelines.select("artifact_id").distinct())


@query(sql="""
SELECT 'unknown_fields' AS code, 'Unrecognized key: ' || k AS message, count(*) AS n FROM (
SELECT unnest(CASE user_id % 3 WHEN 0 THEN ['extra', 'note'] WHEN 1 THEN ['note'] ELSE [] END) AS k FROM events) GROUP BY k""")  # fmt: skip
def unknown_fields(spark):
    """Documents of events, with keys beside the schema at two levels by user."""
    k = F.col("user_id") % 3
    raw = F.concat(F.lit('{"title":"'), "event_type", F.lit('"'), F.when(k == 0, ',"extra":1').otherwise(""), F.lit(',"diagram":{"layout":{}'), F.when(k <= 1, ',"note":"x"').otherwise(""), F.lit("}}"))
    documents = spark.table("events").select(F.col("event_id").cast("string").alias("artifact_id"), raw.alias("raw"))
    found = validate.unknown_fields(documents, {"$": ["title", "diagram"], "$.diagram": ["layout", "graph"]})
    return found.groupBy("code", "message").agg(F.count("*").alias("n"))
