"""Loops over distributed tables.

A round's result is written as a table below spark.checkpoint.dir, which all
executors share: the lineage stays short and a lost executor costs no round. The
shuffle files of the round go with it, so the disk holds one round's at a time.
Loops end on a count of the rows that changed, and raise when they do not come
to an end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Against steps that never end; a finite table ends before, however deep it is.
MAX_ROUNDS = 1 << 20
PARTS = 8  #: tables of rounds that are kept apart before they become one
#: Names of folders that settled has written; discard deletes no others.
WRITTEN: set[str] = set()
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS = "spark.sql.sources.fileCompressionFactor"
#: Bytes of rows that a byte of a file can hold: compressed ids that follow each other. Sides of joins are sent to all tasks by
#: the size of their files, through the driver; what turns out to be small when it is made is sent as before.
PACKED = "50"


def _base(spark: SparkSession) -> str:
    """The folder that all executors share. Sets one only where none is set and
    there is one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphcat-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{_base(spark)}/{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, name: str, value: str, default: str):
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def _releasing_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go from disk when the query has ended."""
    with _set(spark, RELEASE, "true", "false"):
        yield


def settled(df: DataFrame) -> DataFrame:
    """df, computed, written to the checkpoint folder and read again."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    # files have no columns of type void
    named = {c for c, kind in df.dtypes if kind != "void"}
    with _releasing_shuffles(spark), _set(spark, ROWS, PACKED, "1.0"):
        df.select(*(f"`{c}`" for c in df.columns if c in named)).write.option("compression", "zstd").parquet(path)
    WRITTEN.add(path.rpartition("/")[2])
    schema = type(df.schema)([f for f in df.schema if f.name in named])
    return spark.read.schema(schema).parquet(path).select(*(F.col(f"`{c}`") if c in named else F.lit(None).alias(c) for c in df.columns))


def discard(*tables: DataFrame) -> None:
    """Deletes what settled wrote for these tables. Only for tables of which all
    that is made has been written."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if (name := folder.rpartition("/")[2]) not in WRITTEN:
                continue
            WRITTEN.remove(name)
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """All rows reached from seed; step maps the newest rows to their
    successors, of which only keys not seen before go on. A round writes its new
    rows only; now and then those of several rounds become one table."""
    frontier = settled(seed.dropDuplicates(key))
    seen = [frontier]
    for _ in range(max_rounds):
        before = reduce(DataFrame.unionByName, seen)
        frontier = settled(step(frontier).dropDuplicates(key).join(before, key, "left_anti"))
        if frontier.isEmpty():
            return before
        seen.append(frontier)
        if len(seen) > PARTS:
            seen = [settled(reduce(DataFrame.unionByName, seen))]
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
