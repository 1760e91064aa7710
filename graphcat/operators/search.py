"""Search, order and walkthroughs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import link_label

GRAM = 3  #: letters of a key; shorter queries are keys themselves


def _grams(text: str, n: Column) -> Column:
    """The distinct runs of n letters of a text, none if it is shorter."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, n)))


def search_elements(elements: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, artifact_id, type, id, title): titles that contain the query, case
    aside; an empty query finds nothing. elements: artifact_id, type, id, title.

    Titles are indexed by their runs of three letters (one and two for shorter
    queries). Of these, only the ones that queries have are kept; a query looks
    up the rarest of its own, and what is found there is compared."""
    q = queries.select("query", F.lower("query").alias("q")).filter("q <> ''").distinct()
    asked = q.withColumn("n", F.least(F.lit(GRAM), F.length("q"))).select("query", "q", F.explode(_grams("q", F.col("n"))).alias("gram"))
    low = elements.select("artifact_id", "type", "id", "title", F.lower("title").alias("low"))
    sizes = F.explode(F.concat(*(_grams("low", F.lit(n)) for n in range(1, GRAM + 1))))
    index = low.select("*", sizes.alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count("*").alias("titles"))
    # a gram that no title has is the rarest, and its query finds nothing
    rarest = asked.join(counts, "gram", "left").groupBy("query", "q").agg(F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("key"))
    found = index.join(rarest.select("query", "q", F.col("key.gram").alias("gram")), "gram")
    return found.filter(F.contains("low", F.col("q"))).select("query", "artifact_id", "type", "id", "title")


def sort_artifacts(artifacts: DataFrame) -> DataFrame:
    """By title, ties by id, in binary order."""
    return artifacts.orderBy("title", "artifact_id")


def default_artifact(artifacts: DataFrame, requested: DataFrame) -> DataFrame:
    """(scope_id, artifact_id): the requested one (scope_id, requested), else the
    first behavior, else the first design; artifacts: scope_id, artifact_id, kind, title."""
    a = artifacts.join(requested, "scope_id", "left")
    rank = F.when(F.col("artifact_id") == F.col("requested"), 0).when(F.col("kind") == "behavior", 1).otherwise(2)
    return a.groupBy("scope_id").agg(F.min_by("artifact_id", F.struct(rank, F.col("title"), F.col("artifact_id"))).alias("artifact_id"))


def rank_generators(generators: DataFrame) -> DataFrame:
    """generators with place: by id, then built-in, global, project, then path."""
    source = F.when(F.col("source") == "built-in", 0).when(F.col("source") == "global", 1).otherwise(2)
    return generators.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(source, "path")))


def generator_usage(artifacts: DataFrame, generators: DataFrame) -> DataFrame:
    """(generator, source, installed, n): artifacts of each reference, and
    whether a descriptor of that source and id is installed."""
    known = generators.select(F.concat_ws(":", "source", "id").alias("generator"), F.lit(True).alias("known")).distinct()
    used = artifacts.filter("generator IS NOT NULL").groupBy("generator").agg(F.count("*").alias("n"))
    return used.join(known, "generator", "left").select("generator", F.substring_index("generator", ":", 1).alias("source"), F.coalesce("known", F.lit(False)).alias("installed"), "n")


def canvas_annotations(annotations: DataFrame, canvases: DataFrame) -> DataFrame:
    return annotations.join(canvases.select("canvas_id"), "canvas_id", "left_semi")


def walkthrough_emphasis(elements: DataFrame, nodes: DataFrame, edges: DataFrame, provenance: DataFrame) -> DataFrame:
    """(artifact_id, step, type, id, emphasized) for every shown node and edge of
    each step that has elements; provenance (artifact_id, edge_id, origin_id)
    says which stored edges a shown one stands for."""
    steps = elements.select("artifact_id", "step").distinct()
    picked = elements.filter("type IN ('node', 'group')").select("artifact_id", "step", F.col("id").alias("node_id"), F.lit(True).alias("hit")).distinct()
    n = nodes.select("artifact_id", "node_id").join(steps, "artifact_id").join(picked, ["artifact_id", "step", "node_id"], "left")
    stored = elements.filter("type = 'edge'").select("artifact_id", "step", F.col("id").alias("origin_id"))
    shown = stored.join(provenance, ["artifact_id", "origin_id"]).select("artifact_id", "step", "edge_id", F.lit(True).alias("hit")).distinct()
    e = edges.select("artifact_id", "edge_id").join(steps, "artifact_id").join(shown, ["artifact_id", "step", "edge_id"], "left")
    out = lambda df, kind, key: df.select("artifact_id", "step", F.lit(kind).alias("type"), F.col(key).alias("id"), F.coalesce("hit", F.lit(False)).alias("emphasized"))
    return out(n, "node", "node_id").union(out(e, "edge", "edge_id"))


def walkthrough_frames(elements: DataFrame, polylines: DataFrame) -> DataFrame:
    """Bounding box of the points of each step's messages: (artifact_id, step, x,
    y, width, height), at least 1 wide and 48 high."""
    hit = elements.filter("type = 'edge'").select("artifact_id", "step", F.col("id").alias("edge_id"))
    p = hit.join(polylines, ["artifact_id", "edge_id"]).select("artifact_id", "step", F.explode("points").alias("p"))
    box = p.groupBy("artifact_id", "step").agg(F.min("p.x").alias("x"), F.min("p.y").alias("y"), F.max("p.x").alias("r"), F.max("p.y").alias("b"))
    return box.select("artifact_id", "step", "x", "y", F.greatest(F.lit(1.0), F.col("r") - F.col("x")).alias("width"), F.greatest(F.lit(48.0), F.col("b") - F.col("y")).alias("height"))


def decode_walkthrough(parameter: str, schema: str):
    """The JSON of an unpadded base64url parameter; null if it is not canonical."""
    plain = F.translate(parameter, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), (4 - F.length(plain) % 4) % 4))
    data = F.try_to_binary(padded, F.lit("base64"))
    again = F.regexp_replace(F.translate(F.regexp_replace(F.base64(data), "[\r\n]", ""), "+/", "-_"), "=+$", "")
    ok = F.col(parameter).rlike("^[A-Za-z0-9_-]+$") & (again == F.col(parameter))
    return F.when(ok, F.from_json(data.cast("string"), schema))


def audit_shared_walkthroughs(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """links (parameter) to (artifact_id, n_ok, n_invalid, n_undecodable)."""
    schema = "artifactId string, steps array<struct<caption:string>>"
    d = links.select(decode_walkthrough("parameter", schema).alias("w")).select(F.col("w.artifactId").alias("artifact_id"))
    d = d.join(artifacts.select("artifact_id", F.lit(True).alias("known")), "artifact_id", "left")
    return d.groupBy("artifact_id").agg(F.count_if(F.col("known")).alias("n_ok"), F.count_if(F.col("artifact_id").isNotNull() & F.col("known").isNull()).alias("n_invalid"), F.count_if(F.col("artifact_id").isNull()).alias("n_undecodable"))


def link_inventory(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Every link of artifacts, nodes and edges, with its label: links
    (artifact_id, kind, element_id, link_ix, text, href) and edges (artifact_id,
    edge_id, href; null for none). Both may have scope_id."""
    key = [c for c in ("scope_id", "artifact_id") if c in links.columns]
    of_edges = edges.filter("href IS NOT NULL").select(*key, F.lit("edge").alias("kind"), F.col("edge_id").alias("element_id"), F.lit(0).alias("link_ix"), F.lit(None).cast("string").alias("text"), "href")
    every = links.select(*key, "kind", "element_id", "link_ix", "text", "href").unionByName(of_edges)
    return every.withColumn("label", link_label("text", "href"))
