"""Annotations: the log of operations, conflicts of saves and edits, the
annotations of the current revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEY = ("scope_id", "annotation_id")


def annotation_results(log: DataFrame) -> DataFrame:
    """log (scope_id, annotation_id, seq, op, body, x, y) with result: ok,
    blank (a body that is only spaces), missing (an annotation not alive), noop.

    Whether an annotation is alive before an operation is what the last
    publication that was accepted, or removal, before it says. A removal of a
    missing one changes nothing, so it may count, too.
    """
    blank = F.col("op").isin("publish", "update") & (F.length(F.trim("body")) == 0)
    born = F.when((F.col("op") == "publish") & ~blank, True).when(F.col("op") == "remove", False)
    before = Window.partitionBy(*_KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    alive = F.coalesce(F.last(born, ignorenulls=True).over(before), F.lit(False))
    needs = F.col("op").isin("update", "move", "remove")
    result = F.when(~F.col("op").isin("publish", "update", "move", "remove"), "noop").when(blank, "blank").when(needs & ~alive, "missing").otherwise("ok")
    return log.withColumn("result", result)


def fold_annotation_log(log: DataFrame) -> DataFrame:
    """The annotations alive at the end: (scope_id, annotation_id, body, x, y).

    The last accepted body is that of the last publication or update, the last
    point that of the last publication or move; all after the last removal."""
    ok = annotation_results(log).filter("result = 'ok'")
    order = F.col("seq")
    last = lambda c, *ops: F.max_by(c, F.when(F.col("op").isin(*ops), order))
    end = ok.groupBy(*_KEY).agg(F.max(F.when(F.col("op") == "publish", order)).alias("born"), F.max(F.when(F.col("op") == "remove", order)).alias("gone"), last("body", "publish", "update").alias("body"), last("x", "publish", "move").alias("x"), last("y", "publish", "move").alias("y"))
    return end.filter("born > coalesce(gone, -1)").select(*_KEY, "body", "x", "y")


def detect_save_conflicts(submissions: DataFrame, current: DataFrame) -> DataFrame:
    """submissions (scope_id, arrival, revision_id, expected_etag, valid) with
    status, against current (scope_id, revision_id, etag): 428 without an
    expected etag, 422 for an invalid document, 409 for another revision, 412
    for another etag, 200 for the first that fits, 412 for those after it."""
    c = current.select("scope_id", F.col("revision_id").alias("now"), F.col("etag").alias("now_etag"))
    s = submissions.join(c, "scope_id", "left")
    first = F.when(F.col("expected_etag").isNull(), 428).when(~F.col("valid"), 422).when(~F.coalesce(F.col("revision_id") == F.col("now"), F.lit(False)), 409).when(F.col("expected_etag") != F.col("now_etag"), 412).otherwise(200)
    s = s.withColumn("status", first)
    again = F.row_number().over(Window.partitionBy("scope_id", "status").orderBy("arrival")) > 1
    return s.withColumn("status", F.when((F.col("status") == 200) & again, 412).otherwise(F.col("status"))).drop("now", "now_etag")


def reconcile_edits(edits: DataFrame, base: DataFrame, current: DataFrame) -> DataFrame:
    """edits (scope_id, annotation_id) with outcome, three ways: deleted, changed
    (outside) or unchanged, from what they began with and what is there now."""
    h = lambda df, name: df.select(*_KEY, F.xxhash64("body", "x", "y").alias(name))
    e = edits.join(h(base, "was"), list(_KEY), "left").join(h(current, "now"), list(_KEY), "left")
    return e.withColumn("outcome", F.when(F.col("now").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("unchanged")).drop("was", "now")


def resolve_edit_conflicts(edits: DataFrame, current: DataFrame) -> DataFrame:
    """The document after resolutions: edits (scope_id, annotation_id, body, x,
    y, outcome, resolution). keep and restore put the edit in place (restore
    publishes a deleted one again), discard and external leave what is there."""
    won = edits.filter("resolution IN ('keep', 'restore') AND (outcome <> 'deleted' OR resolution = 'restore') OR outcome = 'unchanged' AND resolution <> 'discard'")
    kept = current.join(won, list(_KEY), "left_anti")
    return kept.select(*_KEY, "body", "x", "y").unionByName(won.select(*_KEY, "body", "x", "y"))


def active_annotations(annotations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Annotations of each scope's current revision (scope_id, catalog_revision_id)."""
    return annotations.join(revisions, ["scope_id", "catalog_revision_id"], "left_semi")


def fenced_results(log: DataFrame) -> DataFrame:
    """Operation results that still count: log (scope_id, seq, kind, operation_id,
    revision_id), kind start, result or revision. A result counts if its
    operation is the last started and no revision came since it started."""
    w = Window.partitionBy("scope_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    current = F.last(F.when(F.col("kind") == "start", F.struct("operation_id", "seq")).when(F.col("kind") == "revision", F.struct(F.lit(None).cast("string").alias("operation_id"), F.col("seq"))), ignorenulls=True).over(w)
    return log.withColumn("current", current).filter("kind = 'result'").withColumn("applied", F.coalesce(F.col("current.operation_id") == F.col("operation_id"), F.lit(False))).drop("current")
