"""Time-ordered sequences: positions of messages, lifelines, activations and
fragments, by windows over each artifact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Distances of the layout.
MARGIN, GAP, ROW, LOOP, GUARD = 48, 128, 72, 28, 32
TOP, BOTTOM, SIDE = 68, 24, 24

_ALL_BEFORE = (Window.unboundedPreceding, -1)


def message_ordinals(messages: DataFrame) -> DataFrame:
    """messages with i, their place from 0 within the artifact."""
    return messages.withColumn("i", F.row_number().over(Window.partitionBy("artifact_id").orderBy("ordinal", "edge_id")) - 1)


def header_heights(lifelines: DataFrame) -> DataFrame:
    return lifelines.groupBy("artifact_id").agg(F.max("height").alias("header"))


def message_offsets(messages: DataFrame, lifelines: DataFrame, branches: DataFrame) -> DataFrame:
    """messages with i and y. Loops before a message move it down, and so does
    each place at or before it at which a branch starts."""
    m = message_ordinals(messages)
    starts = branches.select("artifact_id", F.col("start_message_id").alias("edge_id"), F.lit(1).alias("starts")).distinct()
    m = m.join(starts, ["artifact_id", "edge_id"], "left").join(header_heights(lifelines), "artifact_id")
    own = Window.partitionBy("artifact_id").orderBy("i")
    loops = F.coalesce(F.sum((F.col("source_node_id") == F.col("target_node_id")).cast("int")).over(own.rowsBetween(*_ALL_BEFORE)), F.lit(0))
    guards = F.sum(F.coalesce("starts", F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("y", F.col("header") + ROW * (F.col("i") + 1) + LOOP * loops + GUARD * guards).drop("starts", "header")


def lifeline_offsets(lifelines: DataFrame) -> DataFrame:
    """lifelines with x: the margin, and all widths and gaps before."""
    own = Window.partitionBy("artifact_id").orderBy("ordinal", "node_id").rowsBetween(*_ALL_BEFORE)
    return lifelines.withColumn("x", F.coalesce(F.sum(F.col("width") + GAP).over(own), F.lit(0)) + MARGIN)


def _ends(placed: DataFrame, prefix: str) -> DataFrame:
    return placed.select("artifact_id", F.col("edge_id").alias(f"{prefix}_message_id"), F.col("i").alias(f"{prefix}_i"), F.col("y").alias(f"{prefix}_y"))


def activation_spans(activations: DataFrame, placed: DataFrame) -> DataFrame:
    """activations with y and height; those with an unknown message have none."""
    a = activations.join(_ends(placed, "start"), ["artifact_id", "start_message_id"]).join(_ends(placed, "end"), ["artifact_id", "end_message_id"])
    top, low = F.least("start_y", "end_y"), F.greatest("start_y", "end_y") + 24
    return a.select("artifact_id", "node_id", "activation_id", top.alias("y"), F.greatest(low - top, F.lit(16)).alias("height"))


def message_polylines(placed: DataFrame, lifelines: DataFrame) -> DataFrame:
    """(artifact_id, edge_id, i, points): two points, or four around a loop."""
    x = lifeline_offsets(lifelines).select("artifact_id", "node_id", (F.col("x") + F.col("width") / 2).alias("c"), "width")
    ends = placed.join(x.select("artifact_id", F.col("node_id").alias("source_node_id"), F.col("c").alias("sx"), "width"), ["artifact_id", "source_node_id"]).join(x.select("artifact_id", F.col("node_id").alias("target_node_id"), F.col("c").alias("tx")), ["artifact_id", "target_node_id"])
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    y, out = F.col("y"), F.col("sx") + F.col("width") / 2 + GAP / 2
    straight = F.array(point(F.col("sx"), y), point(F.col("tx"), y))
    loop = F.array(point(F.col("sx"), y), point(out, y), point(out, y + LOOP), point(F.col("tx"), y + LOOP))
    return ends.select("artifact_id", "edge_id", "i", F.when(F.col("source_node_id") == F.col("target_node_id"), loop).otherwise(straight).alias("points"))


def lifeline_handles(placed: DataFrame) -> DataFrame:
    """(artifact_id, node_id, handle_id, side, y), two a message."""
    loop = F.when(F.col("source_node_id") == F.col("target_node_id"), LOOP).otherwise(0)
    end = lambda s, side, y: placed.select("artifact_id", F.col(f"{s}_node_id").alias("node_id"), F.concat("edge_id", F.lit(f":{s}")).alias("handle_id"), F.lit(side).alias("side"), y.alias("y"))
    return end("source", "right", F.col("y")).union(end("target", "left", F.col("y") + loop))


def branch_ranges(branches: DataFrame, placed: DataFrame) -> DataFrame:
    """branches with the places and offsets of their messages; unknown ones have none."""
    b = branches.join(_ends(placed, "start"), ["artifact_id", "start_message_id"]).join(_ends(placed, "end"), ["artifact_id", "end_message_id"])
    return b.withColumn("top", F.col("start_y") - TOP).withColumn("bottom", F.col("end_y") + BOTTOM)


def fragment_extents(branches: DataFrame, placed: DataFrame, polylines: DataFrame) -> DataFrame:
    """(artifact_id, fragment_id, x, y, width, height): the box around all
    messages in a fragment's branches. The range join has the artifact as its
    equality key."""
    ranges = branch_ranges(branches, placed)
    points = polylines.select("artifact_id", "i", F.array_min(F.transform("points", lambda p: p["x"])).alias("low"), F.array_max(F.transform("points", lambda p: p["x"])).alias("high"))
    inside = ranges.join(points, "artifact_id").filter("i BETWEEN start_i AND end_i")
    across = inside.groupBy("artifact_id", "fragment_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    down = ranges.groupBy("artifact_id", "fragment_id").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    return across.join(down, ["artifact_id", "fragment_id"]).select("artifact_id", "fragment_id", (F.col("low") - SIDE).alias("x"), F.col("top").alias("y"), (F.col("high") - F.col("low") + 2 * SIDE).alias("width"), (F.col("bottom") - F.col("top")).alias("height"))
