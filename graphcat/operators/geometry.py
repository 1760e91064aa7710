"""Analytics on routed polylines. Segments are axis-aligned: (artifact_id,
segment_id, axis, x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 0.001
CELL = 64.0  #: side of a grid cell


def segments(polylines: DataFrame) -> DataFrame:
    """polylines (artifact_id, edge_id, points) to segments with their place i;
    those of no length have none."""
    p = polylines.select("artifact_id", "edge_id", F.posexplode(F.arrays_zip(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))).alias("a"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))).alias("b"))).alias("i", "s"))
    s = p.select("artifact_id", "edge_id", "i", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    axis = F.when(F.abs(F.col("y1") - F.col("y2")) < EPSILON, "horizontal").when(F.abs(F.col("x1") - F.col("x2")) < EPSILON, "vertical").otherwise("diagonal")
    return s.filter((F.abs(F.col("x1") - F.col("x2")) >= EPSILON) | (F.abs(F.col("y1") - F.col("y2")) >= EPSILON)).withColumn("axis", axis)


def compact_points(points: DataFrame) -> DataFrame:
    """points (artifact_id, edge_id, i, x, y) without repeats and without those
    between two neighbours on one axis-aligned line."""
    w = Window.partitionBy("artifact_id", "edge_id").orderBy("i")
    same = lambda a, b: F.abs(F.col(a) - F.col(b)) < EPSILON
    p = points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).filter(~F.coalesce(same("px", "x") & same("py", "y"), F.lit(False)))
    p = p.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w))
    between = (same("px", "x") & same("x", "nx")) | (same("py", "y") & same("y", "ny"))
    return p.filter(~F.coalesce(between, F.lit(False))).select("artifact_id", "edge_id", "i", "x", "y")


def route_length(points: DataFrame) -> DataFrame:
    """(artifact_id, edge_id, length): along both axes."""
    w = Window.partitionBy("artifact_id", "edge_id").orderBy("i")
    step = F.abs(F.col("x") - F.lag("x").over(w)) + F.abs(F.col("y") - F.lag("y").over(w))
    return points.withColumn("d", step).groupBy("artifact_id", "edge_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def route_midpoint(points: DataFrame) -> DataFrame:
    """(artifact_id, edge_id, x, y): the point at half the straight-line length."""
    own = Window.partitionBy("artifact_id", "edge_id")
    w = own.orderBy("i")
    p = points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).withColumn("d", F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0)))
    p = p.withColumn("cum", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("half", F.sum("d").over(own) / 2)
    first = p.filter("cum >= half - 1e-9").withColumn("k", F.row_number().over(w)).filter("k = 1")
    t = F.when(F.col("d") > 0, (F.col("half") - (F.col("cum") - F.col("d"))) / F.col("d")).otherwise(0.0)
    return first.select("artifact_id", "edge_id", (F.coalesce("px", "x") + (F.col("x") - F.coalesce("px", "x")) * t).alias("x"), (F.coalesce("py", "y") + (F.col("y") - F.coalesce("py", "y")) * t).alias("y"))


def _cells(df: DataFrame, cell: float) -> DataFrame:
    """One row for each grid cell that a box (x1, y1, x2, y2) touches."""
    lo = lambda a, b: F.floor(F.least(a, b) / cell)
    hi = lambda a, b: F.floor((F.greatest(a, b) + EPSILON) / cell)
    return df.withColumn("cx", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2")))).withColumn("cy", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))))


def segment_interactions(segs: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of an artifact's segments (a below b) that overlap or cross:
    (artifact_id, a, b, kind, overlap, x, y). The join's keys are the artifact
    and a grid cell; a pair counts in the first cell of its common box."""
    box = lambda df, p: df.select("artifact_id", "cx", "cy", *(F.col(c).alias(f"{p}{c}") for c in ("segment_id", "axis")), F.least("x1", "x2").alias(f"{p}l"), F.greatest("x1", "x2").alias(f"{p}r"), F.least("y1", "y2").alias(f"{p}t"), F.greatest("y1", "y2").alias(f"{p}b"))
    cells = _cells(segs, cell)
    p = box(cells, "a_").join(box(cells, "b_"), ["artifact_id", "cx", "cy"]).filter("a_segment_id < b_segment_id")
    left, right = F.greatest("a_l", "b_l"), F.least("a_r", "b_r")
    top, low = F.greatest("a_t", "b_t"), F.least("a_b", "b_b")
    p = p.withColumns({"l": left, "r": right, "t": top, "low": low}).filter((F.col("r") - F.col("l") >= -EPSILON) & (F.col("low") - F.col("t") >= -EPSILON))
    # a common box narrower than nothing begins a little before its left edge
    p = p.filter((F.col("cx") == F.floor(F.least("l", "r") / cell)) & (F.col("cy") == F.floor(F.least("t", "low") / cell)))
    along = F.when(F.col("a_axis") == "horizontal", F.col("r") - F.col("l")).otherwise(F.col("low") - F.col("t"))
    same = F.col("a_axis") == F.col("b_axis")
    p = p.withColumn("kind", F.when(same & (along > EPSILON), "overlap").when(~same, "crossing")).filter("kind IS NOT NULL")
    return p.select("artifact_id", F.col("a_segment_id").alias("a"), F.col("b_segment_id").alias("b"), "kind", F.when(same, along).otherwise(0.0).alias("overlap"), "l", "r", "t", "low", F.col("a_axis").alias("axis"))


def segment_congestion(segs: DataFrame, cell: float = CELL) -> DataFrame:
    """(artifact_id, segment_id, overlapped, crossings): the length that other
    segments cover, counted once, and distinct crossing points."""
    pairs = segment_interactions(segs, cell)
    both = pairs.withColumn("segment_id", F.explode(F.array("a", "b")))
    own = segs.select("artifact_id", "segment_id", F.col("axis").alias("own"))
    both = both.join(own, ["artifact_id", "segment_id"])
    flat = F.col("own") == "horizontal"
    spans = both.filter("kind = 'overlap'").select("artifact_id", "segment_id", F.when(flat, F.col("l")).otherwise(F.col("t")).alias("from"), F.when(flat, F.col("r")).otherwise(F.col("low")).alias("to"))
    w = Window.partitionBy("artifact_id", "segment_id").orderBy("from", "to")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("reach", reach).withColumn("new", F.greatest(F.lit(0.0), F.col("to") - F.greatest(F.col("from"), F.coalesce("reach", "from"))))
    length = covered.groupBy("artifact_id", "segment_id").agg(F.sum("new").alias("overlapped"))
    cross = both.filter("kind = 'crossing'").groupBy("artifact_id", "segment_id").agg(F.count_distinct(F.round("l", 3), F.round("t", 3)).alias("crossings"))
    return segs.select("artifact_id", "segment_id").join(length, ["artifact_id", "segment_id"], "left").join(cross, ["artifact_id", "segment_id"], "left").fillna(0)


def obstacle_hits(segs: DataFrame, rects: DataFrame, cell: float = CELL) -> DataFrame:
    """(artifact_id, segment_id, rect_id, enter, leave): segments that run through
    the inside of a rectangle (rect_id, x, y, width, height), and the part of
    them, from 0 to 1, that does."""
    r = rects.select("artifact_id", "rect_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))
    right = _cells(r, cell).select("artifact_id", "cx", "cy", "rect_id", *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    p = _cells(segs, cell).join(right, ["artifact_id", "cx", "cy"]).drop("cx", "cy").dropDuplicates(["artifact_id", "segment_id", "rect_id"])

    def clip(a: str, b: str, low: str, high: str):
        d = F.col(b) - F.col(a)
        t, u = (F.col(low) - F.col(a)) / d, (F.col(high) - F.col(a)) / d
        still = F.abs(d) < EPSILON
        inside = (F.col(a) > F.col(low)) & (F.col(a) < F.col(high))
        return F.when(still, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(t, u)), F.when(still, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(t, u))

    ex, lx = clip("x1", "x2", "r_x1", "r_x2")
    ey, ly = clip("y1", "y2", "r_y1", "r_y2")
    p = p.withColumn("enter", F.greatest(ex, ey, F.lit(0.0))).withColumn("leave", F.least(lx, ly, F.lit(1.0)))
    return p.filter("leave > enter").select("artifact_id", "segment_id", "rect_id", "enter", "leave")
