"""Round trips between runs of documents and ranges of keys.

Some questions need, for each key of a document, something counted over all
documents: how often a word occurs, or which document has a string first.
Documents are dealt by id into runs of bounded size. A run sums up its own
distinct keys, sorted, and sends each range of the key space one packed row.
A range combines what the runs say and answers each run, in the run's own key
order, so an answer needs no keys. A run then reads its documents and its
answers together.

However often a key occurs, a run sends it once. There are fewer ranges than
runs, in the same proportion at every size, and a run sends nothing to a range in which it has
no keys, so there are never more rows than keys. The deal of the documents is
kept as a bucketed table in the shared scratch folder, so later passes over
the runs do not shuffle texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import TABLES, releasing_shuffles, scratch

RUN_BYTES = 12 << 20
RUNS_A_RANGE = 4  #: a range gets as many keys as so many runs have


class Runs:
    """documents: (row, text, id, run, ...), n: how many runs there are, ranges: how
    many ranges of keys. prepare adds columns to the rows before they are dealt."""

    def __init__(self, docs: DataFrame, text: str, id_column: str, keep: list[str] | None, run_bytes: int = RUN_BYTES, prepare: Callable[[DataFrame], DataFrame] | None = None, **more):
        row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
        rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{id_column}`").alias("id"), *(c.alias(name) for name, c in more.items()))
        rows = prepare(rows) if prepare else rows
        total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")) + 64)).first()[0] or 0
        self.n = max(1, -(-total // run_bytes))
        # rows without an id are dealt by their texts, equal ones of both by chance
        key = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("text", F.rand(7)))
        rows = rows.withColumn("run", F.pmod(key, F.lit(self.n)).cast("int"))
        self.documents = bucketed(rows, self.n, "run")
        self.ranges = ranges(self.n)


def parts_of(spark: SparkSession, n: int) -> int:
    """In how many parts n groups are dealt: as many as Spark allows buckets at
    most. Beyond that a part holds several groups, one after the other."""
    return min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def bucketed(rows: DataFrame, n: int, column: str) -> DataFrame:
    """rows, written in buckets by a column of n values, so that groups of it need
    no exchange."""
    table, spark = f"runs_{uuid.uuid4().hex}", rows.sparkSession
    parts = parts_of(spark, n)
    with releasing_shuffles(spark):
        rows.repartition(parts, column).write.bucketBy(parts, column).option("path", f"{scratch(spark)}/runs").saveAsTable(table)
    TABLES.append(table)
    return spark.table(table)


def ranges(runs: int) -> int:
    return -(-runs // RUNS_A_RANGE)


def edges(n: int) -> np.ndarray:
    """The smallest 64-bit key of each of n ranges."""
    return np.arange(n, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // n)


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut into n ranges: n + 1 places."""
    return np.append(np.searchsorted(keys, edges(n)), len(keys))


def unpacked(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]
