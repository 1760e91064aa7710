"""Registry of queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import deal_out, frames, oracle, view_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None, recursive: bool = False):
    """Registers fn(spark, frames of the tables) under its name."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            view_all(spark, sf_dir)
            deal_out(spark, sf_dir, *tables)
            return fn(spark, *frames(spark, sf_dir, *tables))

        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = oracle(sql, *tables, recursive=recursive) if tables else sql
        return fn

    return add


def one(df: DataFrame, artifact: str = "dep") -> DataFrame:
    """A table of one artifact, with its key; order is not known there."""
    out = df.withColumn("artifact_id", F.lit(artifact))
    return out if "ordinal" in out.columns else out.withColumn("ordinal", F.lit(0))


def dep_edges(df: DataFrame) -> DataFrame:
    return one(df).withColumn("edge_id", F.concat_ws(":", F.lit("dependency"), "source_node_id", "target_node_id", "kind")).withColumn("type", F.lit("default"))


EDGE_ID = "'dependency:' || source_node_id || ':' || target_node_id || ':' || kind"
