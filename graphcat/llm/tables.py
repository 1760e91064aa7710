"""Small helpers for tables: input, carried columns, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables and folders made for results that may still be read; see forget().
TABLES: list[str] = []
FOLDERS: list[str] = []


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def carried(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One column `row` with the columns to carry and one column `text`, so that
    no name of the input can clash with a name that an operator adds."""
    names = df.columns if keep is None else keep
    return df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{text}`").alias("text"))


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Sets
    that folder only where it is unset and there is one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphcat-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    FOLDERS.append(f"{base}/{uuid.uuid4().hex}")
    return FOLDERS[-1]


def forget(spark: SparkSession) -> None:
    """Drops all scratch tables and folders that this process made. Results of
    the operators read them until they are written, so call it after that."""
    while TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {TABLES.pop()}")
    while FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the scratch folders that these tables read. Only for tables of
    which all that is made has been written, and that read no input."""
    for df in tables:
        spark = df.sparkSession
        for name in {part for file in df.inputFiles() for part in file.split("/")}:
            for folder in [f for f in FOLDERS if f.endswith(f"/{name}")]:
                FOLDERS.remove(folder)
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def releasing_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go from disk when the query has ended.
    What is written then is a table, so nothing reads them again."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared scratch folder and read again. Cuts lineage and
    survives the loss of executors."""
    path = f"{scratch(df.sparkSession)}/table"
    with releasing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
