"""From raw documents to sharded training data, in five stages.

Each stage takes what the one before kept, as a table with the columns of
documents, and all but the last return such a table:

1. language_id drops documents of which no language can be told: null texts,
   texts without a letter, and those as far from all prototypes as noise is.
2. near_duplicates keeps, of each group of linked documents, the one with the
   smallest id (of several texts of that id in one group, one); documents are
   linked if sets of five words in a row have 80 % of their union in common,
   those without an id or without words with none.
3. decontaminate drops documents of which a twentieth of the words or more
   stands in benchmark passages.
4. mix takes each source's share of words. A document comes once for each time
   that its words are taken, with the words taken so often; one of which no
   word is taken goes.
5. shard deals the rest into shards of near equal bytes, moving the fewest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphcat.llm import decontaminate as contamination
from graphcat.llm import jaccard, langid, mixing, reshard
from graphcat.llm.tables import discard, read, written

#: Below this cosine a text is like none of the languages.
LEAST_SCORE = 0.05
#: Words a shingle and percent of the union in common that make a near copy.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = langid.train(docs.filter(langid.training_fold()))
    found = langid.predict(docs, prototypes)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # an id can have rows of different texts, so what stays is an id and a text
    digest = next(f"text_digest{k}" for k in range(len(docs.columns) + 1) if f"text_digest{k}" not in {c.lower() for c in docs.columns})
    told = docs.withColumn(digest, F.coalesce(F.xxhash64("text"), F.lit(0)))
    groups = jaccard.join_groups(told, keep=["doc_id", digest], n=NEAR_SHINGLE, percent=NEAR_PERCENT).select("row.doc_id", f"row.{digest}", "component", "linked")
    # a text without links is a group of its own
    heads = groups.filter("doc_id = component").groupBy("doc_id", "linked", F.when(F.col("linked").isNull(), F.col(digest)).alias("own")).agg(F.min(digest).alias(digest))
    kept = told.join(heads.select("doc_id", digest), ["doc_id", digest], "left_semi")
    # rows of one id and text are copies, too
    copy = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(F.xxhash64(*(c for c in docs.columns if c != "text"))))
    numbered = kept.select(F.struct(*docs.columns).alias("row"), copy.alias("copy"))
    return numbered.filter("copy = 1").select("row.*").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination.with_verdict(contamination.find_passages(docs, read(spark, sf_dir, "benchmark")))
    return found.filter("NOT contaminated").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_texts(mixing.mixed_documents(docs))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return mixed.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = reshard.reshard(docs, reshard.old_shard_of_source(), F.col("doc_id"))
    added = ("size", "shard", "slot")
    return placed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in added), *added)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Stages 1 and 4 (learned profiles, pseudorandom draws) have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next,
    and what the stage before had written is deleted then."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
