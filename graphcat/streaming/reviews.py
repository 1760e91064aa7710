"""Streams of catalog changes and shared walkthroughs.

States are kept by scope with transformWithState's simpler relative,
applyInPandasWithState; rows come in order of arrival, which is all that the
source defines: there is no event time and no late data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPDATES = "scope_id string, revision long, status string, fingerprint string"
ATTEMPTS = 10


def fingerprints(reads: DataFrame) -> DataFrame:
    """reads (scope_id, seq, status, catalog, annotations) with fingerprint: a
    digest of what a reader would see."""
    return reads.withColumn("fingerprint", F.sha2(F.to_json(F.struct("status", "catalog", "annotations"), {"ignoreNullFields": "false"}), 256)).select("scope_id", "seq", "status", "fingerprint")


def review_updates(reads: DataFrame, stable: bool = False) -> DataFrame:
    """(scope_id, revision, status, fingerprint) each time that a scope's
    fingerprint changes; the same content again is silent, and invalid states
    are told, too.

    With stable, a change counts only when two reads in a row agree, or when
    ATTEMPTS reads have not, as at the start."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, revision, last, tries = state.get if state.exists else ("", 0, "", 0)
        out = []
        # a trigger's rows of a scope may come in several batches
        rows = pd.concat(list(batches)).sort_values("seq")
        for status, mark in zip(rows["status"], rows["fingerprint"], strict=True):
            tries = 0 if mark == last else tries + 1
            agreed = not stable or mark == last or (not told and tries >= ATTEMPTS)
            last = mark
            if agreed and mark != told:
                told, revision, tries = mark, revision + 1, 0
                out.append((key[0], revision, status, mark))
        state.update((told, revision, last, tries))
        yield pd.DataFrame(out, columns=["scope_id", "revision", "status", "fingerprint"])

    return reads.groupBy("scope_id").applyInPandasWithState(follow, UPDATES, "told string, revision long, last string, tries long", "append", GroupStateTimeout.NoTimeout)


def spotlights(walkthroughs: DataFrame, artifacts: DataFrame, elements: DataFrame) -> DataFrame:
    """A stream of walkthroughs (artifact_id, elements array<struct<type,id>>)
    against the tables of the catalog: with status 200, 404 for an unknown
    artifact, 422 if an element is unknown. No state, so nothing is replayed."""
    w = walkthroughs.withColumn("walk", F.xxhash64(*walkthroughs.columns))
    known = w.join(artifacts.select("artifact_id", F.lit(True).alias("known")), "artifact_id", "left")
    ids = elements.groupBy("artifact_id").agg(F.collect_set(F.concat_ws(":", "type", "id")).alias("ids"))
    checked = known.join(ids, "artifact_id", "left")
    fine = F.forall("elements", lambda e: F.array_contains(F.coalesce("ids", F.array().cast("array<string>")), F.concat_ws(":", e["type"], e["id"])))
    return checked.withColumn("status", F.when(F.col("known").isNull(), 404).when(~fine, 422).otherwise(200)).drop("known", "ids", "walk")


def matched_bundles(catalogs: DataFrame, annotations: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Catalog and annotation reads of the same scope and revision; both streams
    have read_at, and wait for each other as long as the watermark says."""
    c = catalogs.withWatermark("read_at", delay)
    a = annotations.select(F.col("scope_id").alias("a_scope"), F.col("revision_id").alias("a_revision"), F.col("read_at").alias("a_read_at"), "document").withWatermark("a_read_at", delay)
    near = F.expr(f"a_read_at BETWEEN read_at - INTERVAL {delay} AND read_at + INTERVAL {delay}")
    return c.join(a, (F.col("scope_id") == F.col("a_scope")) & (F.col("revision_id") == F.col("a_revision")) & near).drop("a_scope", "a_revision", "a_read_at")


FENCED = "scope_id string, seq long, operation_id string, revision_id string, applied boolean"
TRIES = 3
BUNDLES = "scope_id string, seq long, revision_id string, tries long, error string"


def fenced_updates(log: DataFrame) -> DataFrame:
    """operators.annotations.fenced_results as a stream: log (scope_id, seq, kind,
    operation_id, revision_id) to its results, with applied: whether the operation
    is the last one started and no revision came since. A scope's state is the
    operation that is open; a new revision closes it. Results may come in later
    triggers than their start."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (open_operation,) = state.get if state.exists else (None,)
        out = []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, kind, operation, revision in zip(rows["seq"], rows["kind"], rows["operation_id"], rows["revision_id"], strict=True):
            if kind == "start":
                open_operation = operation
            elif kind == "revision":
                open_operation = None
            else:
                out.append((key[0], seq, operation, revision, operation is not None and operation == open_operation))
        state.update((open_operation,))
        yield pd.DataFrame(out, columns=["scope_id", "seq", "operation_id", "revision_id", "applied"])

    return log.groupBy("scope_id").applyInPandasWithState(follow, FENCED, "operation string", "append", GroupStateTimeout.NoTimeout)


def tried_bundles(reads: DataFrame, wait: str = "10 minutes", tries: int = TRIES) -> DataFrame:
    """Bundles of reads that belong together, scope by scope: reads (scope_id, seq,
    read_at, kind, revision_id), kind catalog or annotations, as each loader makes
    them, the catalog first.

    Annotations of the catalog's revision make a bundle; a catalog without a
    revision is one alone. Others are a try that failed; after `tries` of them, or
    when nothing came for `wait` of event time, a row tells the error, and the next
    catalog read begins anew. Annotations without a catalog before are left out,
    and so are reads that come `wait` later than others.
    """
    span = int(pd.Timedelta(wait).total_seconds() * 1000)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, has, failed, last_seq, last_at = state.get if state.exists else (None, False, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            out.append((key[0], last_seq, pending, failed + 1, "No annotations came for the catalog."))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
            for seq, at, kind, revision in zip(rows["seq"], rows["read_at"], rows["kind"], rows["revision_id"], strict=True):
                last_seq, last_at = int(seq), max(last_at, int(at.timestamp() * 1000))
                if kind == "catalog":
                    pending, has = revision, True
                    if revision is None:
                        out.append((key[0], seq, None, failed + 1, None))
                        pending, has, failed = None, False, 0
                elif has and revision == pending:
                    out.append((key[0], seq, revision, failed + 1, None))
                    pending, has, failed = None, False, 0
                elif has:
                    pending, has, failed = None, False, failed + 1
                    if failed >= tries:
                        out.append((key[0], seq, revision, failed, "Catalog and annotation revisions did not match."))
                        failed = 0
            state.update((pending, has, failed, last_seq, last_at))
            if has:
                state.setTimeoutTimestamp(max(last_at, state.getCurrentWatermarkMs()) + span)
        yield pd.DataFrame(out, columns=["scope_id", "seq", "revision_id", "tries", "error"])

    kept = "pending string, has boolean, failed long, last_seq long, last_at long"
    return reads.withWatermark("read_at", wait).groupBy("scope_id").applyInPandasWithState(follow, BUNDLES, kept, "append", GroupStateTimeout.EventTimeTimeout)
