"""Catalogs of artifact documents: found, parsed, exploded, written back.

Schemas are explicit; nothing is inferred. A document that does not parse
becomes a row of the error table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import glob_regex
from ..operators.modules import apply_ignore_rules

DEFAULT_INCLUDE = ("**/*.diagram.json",)  #: files beside the central directory; both are parameters
SKIPPED = (".git", "node_modules")

_REQUIREMENTS = "array<array<struct<controlId:string,value:string>>>"
ARTIFACT = f"""
type string, title string, updatedAt string, generator string, instructions string,
vcs struct<commit:string,branch:string>, links array<struct<text:string,href:string>>,
diagram struct<layout:struct<id:string,options:map<string,string>>, graph:struct<
  groups:array<struct<groupId:string,type:string,title:string,description:string,parentGroupId:string,hideTitle:boolean,synthetic:boolean>>,
  nodes:array<struct<nodeId:string,type:string,title:string,description:string,kind:string,groupId:string,synthetic:boolean,links:array<struct<text:string,href:string>>,
    activations:array<struct<activationId:string,startsAt:struct<messageId:string,endpoint:string>,endsAt:struct<messageId:string,endpoint:string>>>,
    branches:array<struct<branchId:string,label:string,startMessageId:string,endMessageId:string>>>>,
  edges:array<struct<edgeId:string,type:string,sourceNodeId:string,targetNodeId:string,label:string,kind:string,href:string,messageType:string,activeWhen:{_REQUIREMENTS}>>,
  layoutContext:struct<rootNodeIds:array<string>,
    controls:array<struct<controlId:string,type:string,ownerNodeId:string,label:string,polarityPair:boolean,dependsOn:{_REQUIREMENTS},cases:array<struct<caseId:string,label:string>>>>,
    auxiliaryDefinitions:array<struct<definitionId:string,title:string>>>>>
"""

# Known layouts, and generators that have a contract of their own.
LAYOUTS = ("general", "sequence", "dependency-graph", "component-structure")
GENERATORS = {"built-in:flowchart": "flowchart"}


def read_texts(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """(path, raw): whole files below root, by path relative to it."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    resolved = folder.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(folder).toUri().getPath().rstrip("/")
    # file paths are URLs: decoded, without scheme and host, they begin with the root
    path = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(//[^/]*)?/", "/")
    return files.select(F.substr(path, F.lit(len(resolved) + 2)).alias("path"), F.col("value").alias("raw"))


def select_paths(paths: DataFrame, include: tuple[str, ...] = DEFAULT_INCLUDE, central: str = "diagrams", ignore: list[str] | None = None) -> DataFrame:
    """JSON files of the central directory, always, and files that match an
    include and are not ignored."""
    wanted = F.lit(False)
    for g in include:
        wanted = wanted | F.col("path").rlike(glob_regex(g))
    inside = F.col("path").startswith(central + "/") & F.col("path").endswith(".json")
    others = paths.filter(wanted & ~inside)
    if ignore:
        others = apply_ignore_rules(others.withColumn("slashed", F.concat(F.lit("/"), "path")), ignore, "slashed").drop("slashed")
    return paths.filter(inside).unionByName(others)


def source_inventory(paths: DataFrame, extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")) -> DataFrame:
    """Paths with one of the extensions, outside skipped directories."""
    skip = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    return paths.filter(F.element_at(F.split("path", r"\."), -1).isin(*extensions) & ~F.col("path").rlike(skip))




def parse_artifacts(texts: DataFrame) -> DataFrame:
    """texts (scope_id, artifact_id, raw) with document, layout_id and error, of
    which one of the last two is null. A flowchart's layout id is flowchart."""
    schema = f"{ARTIFACT.strip()}, _corrupt_record string"
    d = texts.withColumn("document", F.from_json("raw", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    layout = F.col("document.diagram.layout.id")
    error = (
        F.when(F.col("document").isNull() | F.col("document._corrupt_record").isNotNull(), "is not valid JSON of an artifact")
        .when(layout.isNull(), "diagram.layout.id: Required")
        .when(~layout.isin(*LAYOUTS), F.concat(F.lit("diagram.layout.id: Unknown layout "), layout))
        .when(F.coalesce(F.length("document.title"), F.lit(0)) == 0, "title: Required")
        .when(F.col("document.diagram.graph").isNull(), "diagram.graph: Required")
    )
    own = layout
    for generator, name in GENERATORS.items():
        own = F.when(F.col("document.generator") == generator, name).otherwise(own)
    d = d.withColumn("error", F.when(error.isNotNull(), F.concat("artifact_id", F.lit(": "), error)))
    return d.withColumn("layout_id", F.when(F.col("error").isNull(), own))


def with_defaults(table: str, df: DataFrame) -> DataFrame:
    """Fields that may be left out, filled."""
    if table == "groups":
        return df.withColumns({"type": F.coalesce("type", F.lit("default")), "hide_title": F.coalesce("hide_title", F.lit(False)), "synthetic": F.coalesce("synthetic", F.lit(False))})
    if table == "nodes":
        return df.withColumns({"type": F.coalesce("type", F.lit("default")), "synthetic": F.coalesce("synthetic", F.lit(False))})
    if table == "edges":
        kind = F.coalesce("type", F.lit("default"))
        return df.withColumns({"type": kind, "message_type": F.when(kind == "message", F.coalesce("message_type", F.lit("sync")))})
    return df.withColumn("polarity_pair", F.coalesce("polarity_pair", F.lit(False)))


def explode_graph(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables of all valid documents, each with the element's ordinal."""
    d = parsed.filter("error IS NULL").select("scope_id", "artifact_id", "layout_id", F.col("document.diagram.graph").alias("g"))
    key = ("scope_id", "artifact_id")

    def each(of: DataFrame, array: str, *fields: tuple[str, str], more: tuple[str, ...] = ()) -> DataFrame:
        x = of.select(*key, *more, F.posexplode(array).alias("ordinal", "x"))
        return x.select(*key, *more, "ordinal", *(F.col(f"x.{a}").alias(b) for a, b in fields))

    groups = each(d, "g.groups", ("groupId", "group_id"), ("type", "type"), ("title", "title"), ("description", "description"), ("parentGroupId", "parent_group_id"), ("hideTitle", "hide_title"), ("synthetic", "synthetic"))
    nodes = each(d, "g.nodes", ("nodeId", "node_id"), ("type", "type"), ("title", "title"), ("description", "description"), ("kind", "kind"), ("groupId", "group_id"), ("synthetic", "synthetic"), ("links", "links"), ("activations", "activations"), ("branches", "branches"))
    edges = each(d, "g.edges", ("edgeId", "edge_id"), ("type", "type"), ("sourceNodeId", "source_node_id"), ("targetNodeId", "target_node_id"), ("label", "label"), ("kind", "kind"), ("href", "href"), ("messageType", "message_type"), ("activeWhen", "active_when"))
    controls = each(d, "g.layoutContext.controls", ("controlId", "control_id"), ("type", "type"), ("ownerNodeId", "owner_node_id"), ("label", "label"), ("polarityPair", "polarity_pair"), ("dependsOn", "depends_on"), ("cases", "cases"))
    rules = edges.filter("active_when IS NOT NULL").select(*key, "edge_id", F.posexplode("active_when").alias("rule_ix", "rule")).select(*key, "edge_id", "rule_ix", F.posexplode("rule").alias("req_ix", "q"))
    prerequisites = controls.select(*key, "control_id", F.posexplode("depends_on").alias("rule_ix", "rule")).select(*key, "control_id", "rule_ix", F.posexplode("rule").alias("req_ix", "q"))
    return {
        "groups": with_defaults("groups", groups),
        "nodes": with_defaults("nodes", nodes.drop("activations", "branches", "links")),
        "edges": with_defaults("edges", edges.drop("active_when")),
        "activations": each(nodes, "activations", ("activationId", "activation_id"), ("startsAt.messageId", "start_message_id"), ("startsAt.endpoint", "start_endpoint"), ("endsAt.messageId", "end_message_id"), ("endsAt.endpoint", "end_endpoint"), more=("node_id",)),
        "branches": each(nodes.withColumnRenamed("node_id", "fragment_id"), "branches", ("branchId", "branch_id"), ("label", "label"), ("startMessageId", "start_message_id"), ("endMessageId", "end_message_id"), more=("fragment_id",)),
        "controls": with_defaults("controls", controls.withColumn("n_rules", F.when(F.col("depends_on").isNotNull(), F.size("depends_on"))).drop("cases", "depends_on")),
        "cases": each(controls, "cases", ("caseId", "case_id"), ("label", "label"), more=("control_id",)),
        "requirements": rules.select(*key, "edge_id", "rule_ix", "req_ix", F.col("q.controlId").alias("control_id"), F.col("q.value").alias("value")),
        "roots": d.select(*key, F.posexplode("g.layoutContext.rootNodeIds").alias("ordinal", "node_id")),
        "aux_definitions": each(d, "g.layoutContext.auxiliaryDefinitions", ("definitionId", "definition_id"), ("title", "title")),
        "links": nodes.select(*key, F.lit("node").alias("kind"), F.col("node_id").alias("element_id"), F.posexplode("links").alias("link_ix", "l")).unionByName(parsed.filter("error IS NULL").select(*key, F.lit("artifact").alias("kind"), F.lit(None).cast("string").alias("element_id"), F.posexplode("document.links").alias("link_ix", "l"))).select(*key, "kind", "element_id", "link_ix", "l.*"),
        "prerequisites": prerequisites.select(*key, "control_id", "rule_ix", "req_ix", F.col("q.controlId").alias("req_control_id"), F.col("q.value").alias("value")),
        "rules": edges.filter("active_when IS NOT NULL").select(*key, "edge_id", F.size("active_when").alias("n_rules")),
    }


def read_catalog(spark: SparkSession, root: str, scope_id: str = ".", include: tuple[str, ...] = DEFAULT_INCLUDE, ignore: list[str] | None = None) -> DataFrame:
    """All artifacts of a scope, parsed, errors included."""
    texts = select_paths(read_texts(spark, root), include, ignore=ignore).select(F.lit(scope_id).alias("scope_id"), F.col("path").alias("artifact_id"), "raw")
    return parse_artifacts(texts)


def scope_status(parsed: DataFrame) -> DataFrame:
    """(scope_id, status, n_artifacts, n_errors): invalid as a whole with any error."""
    g = parsed.groupBy("scope_id").agg(F.count("*").alias("n_artifacts"), F.count("error").alias("n_errors"))
    return g.withColumn("status", F.when(F.col("n_errors") > 0, "invalid").otherwise("valid"))


def envelopes_of(parsed: DataFrame) -> DataFrame:
    """What valid documents have beside their graph, for documents_of()."""
    d, g = "document.", "document.diagram."
    fields = {"type": f"{d}type", "title": f"{d}title", "updated_at": f"{d}updatedAt", "generator": f"{d}generator", "instructions": f"{d}instructions", "vcs": f"{d}vcs", "layout_id": f"{g}layout.id", "options": f"{g}layout.options"}
    return parsed.filter("error IS NULL").select("scope_id", "artifact_id", *(F.col(c).alias(k) for k, c in fields.items()))


def documents_of(tables: dict[str, DataFrame], envelopes: DataFrame) -> DataFrame:
    """(scope_id, artifact_id, raw): documents nested again from the tables of
    explode_graph() and envelopes (type, title, layout_id and, if they have
    them, the other columns of envelopes_of()). Defaults are left out, so are
    empty lists of what a node, control or document need not have."""
    key = ["scope_id", "artifact_id"]
    less = lambda c, default: F.nullif(F.col(c), F.lit(default))

    def nested(df: DataFrame, name: str, by: list[str], order: str, **fields: Column) -> DataFrame:
        """One list of structs for each key, in order."""
        item = F.struct(F.col(order).alias("at"), *(c.alias(k) for k, c in fields.items()))
        return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(*(x[k].alias(k) for k in fields))).alias(name))

    def rulesets(requirements: DataFrame, counts: DataFrame, of: str, control: str, name: str) -> DataFrame:
        """Lists of n_rules rules, those without requirements empty."""
        rules = nested(requirements, "rule", [*key, of, "rule_ix"], "req_ix", controlId=F.col(control), value=F.col("value"))
        rules = rules.groupBy(*key, of).agg(F.map_from_entries(F.collect_list(F.struct("rule_ix", "rule"))).alias("rules"))
        empty = F.array().cast("array<struct<controlId:string,value:string>>")
        # element by element, as a rule may have no entry
        full = F.transform(F.sequence(F.lit(0), F.col("n_rules") - 1), lambda i: F.coalesce(F.try_element_at("rules", i), empty))
        out = counts.filter("n_rules IS NOT NULL").select(*key, of, "n_rules").join(rules, [*key, of], "left")
        return out.select(*key, of, F.when(F.col("n_rules") == 0, F.array().cast(_REQUIREMENTS)).otherwise(full).alias(name))

    t = tables
    links = nested(t["links"], "links", [*key, "kind", "element_id"], "link_ix", text=F.col("text"), href=F.col("href"))
    place = lambda side: F.struct(F.col(f"{side}_message_id").alias("messageId"), F.col(f"{side}_endpoint").alias("endpoint"))
    activations = nested(t["activations"], "activations", [*key, "node_id"], "ordinal", activationId=F.col("activation_id"), startsAt=place("start"), endsAt=place("end"))
    branches = nested(t["branches"], "branches", [*key, "fragment_id"], "ordinal", branchId=F.col("branch_id"), label=F.col("label"), startMessageId=F.col("start_message_id"), endMessageId=F.col("end_message_id")).withColumnRenamed("fragment_id", "node_id")
    of_node = links.filter("kind = 'node'").select(*key, F.col("element_id").alias("node_id"), "links")
    nodes = t["nodes"].join(of_node, [*key, "node_id"], "left").join(activations, [*key, "node_id"], "left").join(branches, [*key, "node_id"], "left")
    edges = t["edges"].join(rulesets(t["requirements"], t["rules"], "edge_id", "control_id", "active_when"), [*key, "edge_id"], "left")
    cases = nested(t["cases"], "cases", [*key, "control_id"], "ordinal", caseId=F.col("case_id"), label=F.col("label"))
    before = rulesets(t["prerequisites"], t["controls"], "control_id", "req_control_id", "depends_on")
    controls = t["controls"].join(cases, [*key, "control_id"], "left").join(before, [*key, "control_id"], "left")

    element = {"type": less("type", "default"), "title": F.col("title"), "description": F.col("description")}
    parts = [
        nested(t["groups"], "groups", key, "ordinal", groupId=F.col("group_id"), **element, parentGroupId=F.col("parent_group_id"), hideTitle=less("hide_title", False), synthetic=less("synthetic", False)),
        nested(nodes, "nodes", key, "ordinal", nodeId=F.col("node_id"), **element, kind=F.col("kind"), groupId=F.col("group_id"), synthetic=less("synthetic", False), links=F.col("links"), activations=F.col("activations"), branches=F.col("branches")),
        nested(edges, "edges", key, "ordinal", edgeId=F.col("edge_id"), type=less("type", "default"), sourceNodeId=F.col("source_node_id"), targetNodeId=F.col("target_node_id"), label=F.col("label"), kind=F.col("kind"), href=F.col("href"), messageType=less("message_type", "sync"), activeWhen=F.col("active_when")),
        t["roots"].groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "node_id"))), lambda x: x["node_id"]).alias("rootNodeIds")),
        nested(controls, "controls", key, "ordinal", controlId=F.col("control_id"), type=F.col("type"), ownerNodeId=F.col("owner_node_id"), label=F.col("label"), polarityPair=less("polarity_pair", False), dependsOn=F.col("depends_on"), cases=F.col("cases")),
        nested(t["aux_definitions"], "auxiliaryDefinitions", key, "ordinal", definitionId=F.col("definition_id"), title=F.col("title")),
        links.filter("kind = 'artifact'").select(*key, "links"),
    ]
    d = envelopes
    for name, kind in (("updated_at", "string"), ("generator", "string"), ("instructions", "string"), ("vcs", "struct<commit:string,branch:string>"), ("options", "map<string,string>")):
        if name not in d.columns:
            d = d.withColumn(name, F.lit(None).cast(kind))
    for part in parts:
        d = d.join(part, key, "left")
    some = F.coalesce("rootNodeIds", F.array().cast("array<string>"))
    context = F.when(F.coalesce(F.col("rootNodeIds").isNotNull() | F.col("controls").isNotNull() | F.col("auxiliaryDefinitions").isNotNull(), F.lit(False)), F.struct(some.alias("rootNodeIds"), "controls", "auxiliaryDefinitions"))
    none = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    graph = F.struct(none("groups"), none("nodes"), none("edges"), context.alias("layoutContext"))
    layout = F.struct(F.col("layout_id").alias("id"), "options")
    document = F.struct("type", "title", F.col("updated_at").alias("updatedAt"), "generator", "instructions", "vcs", "links", F.struct(layout.alias("layout"), graph.alias("graph")).alias("diagram"))
    return d.select(*key, F.to_json(document).alias("raw"))


def write_artifacts(documents: DataFrame, path: str) -> None:
    """Documents as lines of JSON, one folder a scope."""
    documents.select("scope_id", "artifact_id", "raw").write.mode("overwrite").partitionBy("scope_id").json(path)
