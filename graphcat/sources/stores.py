"""Annotation documents by catalog revision, manifests of generators, inputs of
the graph builders, and source links held against an inventory."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X

#: Digests of a scope's artifacts are taken together by so many leading hex digits.
DIGITS = 3

POINTER = "scope_id string, catalog_revision_id string, version string, written_at long"
# The form of a generator's id, and the keys of its manifest.
GENERATOR_ID = "^[a-z0-9]+(-[a-z0-9]+)*$"
MANIFEST_KEYS = ("id", "description")

CANDIDATE = "source string NOT NULL, specifier string NOT NULL, pass string NOT NULL, resolved string, could_not_resolve boolean, type_only boolean"
PASSES = ("import", "require", "types")
RULES = "array<array<struct<control_id:string,value:string>>>"
FACTS = {
    "definitions": "definition_id string NOT NULL, name string NOT NULL, path string",
    "uses": f"use_id string NOT NULL, parent_definition string NOT NULL, definition_id string NOT NULL, ruleset {RULES}",
    "supplied": f"value_id string NOT NULL, use_id string NOT NULL, prop string NOT NULL, kind string, ruleset {RULES}",
    "consumers": "component string NOT NULL, prop string NOT NULL, kind string NOT NULL, to_component string, to_prop string, excluded array<string>",
}


def catalog_revisions(artifacts: DataFrame, *content: str) -> DataFrame:
    """(scope_id, catalog_revision_id): a digest of each scope's artifacts
    (scope_id, artifact_id) and the columns that make up their content, whatever
    their order. Digests are taken of groups first, so no scope meets in one
    place."""
    # each value after its length, so that no other values make the same text
    told = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    one = F.sha2(F.concat(*(told(c) for c in ("artifact_id", *content))), 256)
    digests = artifacts.select("scope_id", one.alias("digest"))
    together = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    groups = digests.groupBy("scope_id", F.left("digest", F.lit(DIGITS)).alias("start")).agg(together("digest").alias("digest"))
    return groups.groupBy("scope_id").agg(together("digest").alias("catalog_revision_id"))


def write_annotations(annotations: DataFrame, path: str) -> str:
    """Replaces the documents of all (scope_id, catalog_revision_id) that occur,
    each at once for readers: a new version is written first, then the pointers
    to it are added. Returns the version."""
    version = uuid.uuid4().hex
    annotations.write.json(f"{path}/versions/version={version}")
    made = annotations.sparkSession.read.schema(annotations.schema).json(f"{path}/versions/version={version}")
    pointers = made.select("scope_id", "catalog_revision_id").distinct()
    pointers.select("*", F.lit(version).alias("version"), F.lit(time.time_ns()).alias("written_at")).write.mode("append").json(f"{path}/pointers")
    return version


def read_annotations(spark: SparkSession, path: str, revisions: DataFrame, schema: T.StructType) -> DataFrame:
    """The annotations of revisions (scope_id, catalog_revision_id), of the last
    version that was written of each; a revision without any has one row of
    nulls. schema is that of the annotations written."""
    last = Window.partitionBy("scope_id", "catalog_revision_id").orderBy(F.desc("written_at"), F.desc("version"))
    pointers = spark.read.schema(POINTER).json(f"{path}/pointers").withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k", "written_at")
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())])).json(f"{path}/versions")
    key = ["scope_id", "catalog_revision_id"]
    return revisions.select(*key).join(stored.join(pointers, [*key, "version"]).drop("version"), key, "left")


def parse_manifests(texts: DataFrame) -> DataFrame:
    """texts (path, raw) to (path, id, description, prompt, error): front matter
    between two lines of three dashes, then the prompt. The first fault is told;
    a text with one has no other values."""
    # all white space goes, not only spaces
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.split(F.replace("raw", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    t = texts.withColumn("lines", lines).withColumn("close", F.array_position(F.slice("lines", 2, F.size("lines")), "---"))
    matter = F.filter(F.slice("lines", 2, F.greatest(F.col("close") - 1, F.lit(0)).cast("int")), lambda x: trim(x) != "")
    t = t.withColumn("matter", matter).withColumn("malformed", F.get(F.filter("matter", lambda x: F.instr(x, ":") < 2), 0))
    field = lambda x: F.struct(trim(F.substring_index(x, ":", 1)).alias("key"), trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"))
    t = t.withColumn("fields", F.transform("matter", field))
    keys = F.col("fields.key")
    value = lambda k: F.get(F.filter("fields", lambda f: f["key"] == k), 0)["value"]
    t = t.withColumns({"id": value("id"), "description": value("description"), "prompt": trim(F.array_join(F.slice("lines", (F.col("close") + 2).cast("int"), F.size("lines")), "\n"))})
    unknown = F.get(F.array_except(keys, F.array(*map(F.lit, MANIFEST_KEYS))), 0)
    again = F.get(F.filter(keys, lambda k: F.size(F.filter(keys, lambda j: j == k)) > 1), 0)
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = (
        F.when(F.get("lines", 0) != "---", "Missing opening frontmatter delimiter")
        .when(F.col("close") == 0, "Missing closing frontmatter delimiter")
        .when(F.col("malformed").isNotNull(), F.concat(F.lit("Malformed frontmatter line: "), "malformed"))
        .when(unknown.isNotNull(), F.concat(F.lit("Unknown frontmatter key: "), unknown))
        .when(again.isNotNull(), F.concat(F.lit("Duplicate frontmatter key: "), again))
        .when(missing("id"), "Missing id")
        .when(missing("description"), "Missing description")
        .when(missing("prompt"), "Missing prompt")
        .when(~F.col("id").rlike(GENERATOR_ID), F.concat(F.lit("Invalid id: "), "id"))
    )
    t = t.withColumn("error", error)
    return t.select("path", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("id", "description", "prompt")), "error")


def read_generators(spark: SparkSession, *roots: str) -> DataFrame:
    """Manifests GENERATOR.md of the folders directly below the roots, parsed."""
    files = spark.read.option("pathGlobFilter", "GENERATOR.md").text([f"{r.rstrip('/')}/*/" for r in roots], wholetext=True)
    return parse_manifests(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))


def _with_schema(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON table of a fixed schema; rows without a field that must be there
    are an error when read."""
    schema = T.StructType.fromDDL(ddl)
    rows = spark.read.schema(schema).json(path)
    for f in schema.fields:
        if not f.nullable:
            fault = F.raise_error(F.lit(f"{path}: {f.name} is null")).cast(f.dataType)
            rows = rows.withColumn(f.name, F.coalesce(F.col(f.name), fault))
    return rows


def read_dependency_candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each pass, source and specifier (see choose_dependency)."""
    rows = _with_schema(spark, path, CANDIDATE)
    fault = F.raise_error(F.concat(F.lit("unknown pass "), "pass")).cast("string")
    return rows.withColumn("pass", F.when(F.col("pass").isin(*PASSES), F.col("pass")).otherwise(fault))


def read_component_facts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that component graphs are built from: definitions, their uses,
    values supplied to uses, and what components do with them."""
    return {name: _with_schema(spark, f"{path}/{name}", schema) for name, schema in FACTS.items()}


def audit_links(links: DataFrame, inventory: DataFrame, href: str = "href") -> DataFrame:
    """links with source_path, status and message of each source link: 400 bad
    link, 404 no such file, 403 resolves outside the scope, 422 not a file, else
    200. inventory (source_path, inside, is_file) has what paths resolve to."""
    parsed = links.withColumn("_p", X.parse_source_href(href)).withColumn("source_path", F.col("_p.path"))
    known = inventory.select("source_path", F.coalesce("inside", F.lit(True)).alias("_inside"), F.coalesce("is_file", F.lit(True)).alias("_file")).dropDuplicates(["source_path"])
    found = parsed.join(known, "source_path", "left")
    said = lambda s: F.concat(F.lit(s), "source_path")

    def by_case(*values: Column) -> Column:
        bad, lost, outside, other, fine = values
        return F.when(F.col("_p.error").isNotNull(), bad).when(F.col("_inside").isNull(), lost).when(~F.col("_inside"), outside).when(~F.col("_file"), other).otherwise(fine)

    status = by_case(*map(F.lit, (400, 404, 403, 422, 200)))
    message = by_case(F.concat(F.lit("Source href is invalid: "), F.col("_p.error")), said("Source file does not exist: "), F.lit("Source path resolves outside the review scope."), said("Source path is not a file: "), F.lit(None).cast("string"))
    return found.withColumns({"status": status, "message": message}).drop("_p", "_inside", "_file")
