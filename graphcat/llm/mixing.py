"""Mixing sources to target weights, with DataFrame functions only.

The words of a source are packed, document after document, into blocks of a
fixed length. The mix has as many slots for a source as its target asks for,
and output shards of a fixed number of slots. Which slots a shard gets is drawn:
the slots of all sources are numbered through and a pseudorandom permutation of
those numbers is cut into shards, so the counts of the sources in a shard are
multinomial, given that all shards together meet the targets. The j-th slot of a
source takes the block at place j of a pseudorandom permutation of the source's
blocks; having gone through all, it starts anew with another permutation. Slots
and documents meet by block index.

The permutations are swap-or-not shuffles: in each of some rounds a number x of n
is paired with the one at the other end of a drawn sum, and a bit drawn for the
pair says whether x becomes that one. That is a permutation of any n, keyed by
source, without a table.

Running totals are taken within hashed buckets of a source and joined to the
buckets' offsets, so that a source of any size never stands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read, written

BLOCK = 64  #: words in a block
SLOTS = 1 << 14  #: slots in an output shard, about a million words
BUCKETS = 256  #: of a source, for running totals
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 17
ROUNDS = 12  #: of a permutation
CHUNK = 1 << 14  #: slots that one row stands for at first

_BEFORE = (Window.unboundedPreceding, -1)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offsets(docs: DataFrame, text: str, source: str, key: str, keep: list[str] | None = None) -> DataFrame:
    """Each document with the number of words of its source that stand before it:
    (row, source, key, size, crc, at)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), word_count(f"`{text}`").alias("size"), F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(-1)).alias("crc"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key", "crc"), F.lit(BUCKETS)).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    target = least(cap * source_size, level * weight), at the level at which
    the targets make up share * all. That is what resharing the excess by
    weight until none is above its cap ends in. One row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("full", cap * F.col("source_size") / F.col("weight"))
    by_full = Window.orderBy("full", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum(cap * F.col("source_size")).over(by_full.rowsBetween(*_BEFORE)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(by_full.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) * share - F.col("before")) / F.col("rest"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of x, from 0 to n - 1, in a permutation of n that depends on key."""

    def swap_or_not(now: Column, r: Column) -> Column:
        # least and greatest of the pair stay the same if x is the other one
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - now, n)
        return F.when(F.xxhash64(key, r, F.greatest(now, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(now)

    return F.aggregate(F.array(*map(F.lit, range(rounds))), x.cast("long"), swap_or_not)


def slots_in_all(plan: DataFrame, block: int, cap: int, seed: int) -> DataFrame:
    """(source, blocks, slots, offset, all) from (source, source_size, target):
    slots of each source, rounded by a draw, up to cap times its blocks; and how
    many slots the sources before it, and all, have. One row a source."""
    s = plan.filter("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    draw = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    slots = F.floor(F.col("target") / F.col("source_size") * F.col("blocks") + draw)
    s = s.withColumn("slots", F.least(cap * F.col("blocks"), slots).cast("long"))
    before = F.coalesce(F.sum("slots").over(Window.orderBy(F.col("source").asc_nulls_first()).rowsBetween(*_BEFORE)), F.lit(0))
    return s.select("source", "blocks", "slots", before.alias("offset"), F.sum("slots").over(Window.partitionBy()).alias("all"))


def draws(plan: DataFrame, block: int, slots: int, cap: int, seed: int) -> DataFrame:
    """Slots of each source in each output shard: (source, blocks, shard, from, n).

    from is the source's first slot there, counted over all shards."""
    s = slots_in_all(plan, block, cap, seed).filter("slots > 0")
    chunks = s.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))))
    # by number, as small rows that stand for many slots must not be put together
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(tasks, "source", "chunk")
    first, last = F.col("chunk") * CHUNK, F.least(F.col("slots"), (F.col("chunk") + 1) * CHUNK)
    each = chunks.select("source", "blocks", "all", F.explode(F.sequence(F.col("offset") + first, F.col("offset") + last - 1)).alias("number"))
    shard = F.floor(permuted(F.col("number"), F.col("all"), F.lit(seed + 1)) / slots)
    counts = each.select("source", "blocks", shard.alias("shard")).groupBy("source", "blocks", "shard").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("shard").rowsBetween(*_BEFORE)), F.lit(0))
    return counts.withColumn("from", start).repartition(tasks, "source", "shard")


def slots_of(drawn: DataFrame, seed: int) -> DataFrame:
    """(shard, source, slot, block): the block that each slot takes."""
    each = drawn.withColumn("slot", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    each = each.withColumn("key", F.xxhash64("source", turn, F.lit(seed + 2)))
    return each.select("shard", "source", "slot", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("key")).alias("block"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", block: int = BLOCK, slots: int = SLOTS, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """row (the columns to keep, or all), size, source_size, target, taken and pieces: the word
    ranges (start, n, times) of the document that stand in blocks, in order.

    taken is the number of words that the mix takes, repeats counted. A null or
    empty text has size 0, no pieces and taken 0. Null is a source of its own.
    Repeated rows stand side by side. An empty table gives an empty result.
    """
    # words are counted once
    rows = written(offsets(docs, text, source, key, keep))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0))
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("start"))
    plan = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    within = Window.partitionBy("source", "bucket").orderBy("key", "crc", "size").rowsBetween(*_BEFORE)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("at") + F.col("start")).drop("s", "b", "start", "bucket")
    facts = plan.select(F.col("source").alias("s"), "source_size", "target")
    rows = rows.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    pieces = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    first = F.greatest(F.col("block") * block, F.col("at"))
    pieces = pieces.select("source", "at", "block", (first - F.col("at")).alias("first"), (F.least(F.col("block") * block + block, F.col("at") + F.col("size")) - first).alias("n"))
    times = slots_of(draws(plan, block, slots, cap, seed), seed).groupBy("source", "block").agg(F.count("*").alias("times"))
    times = times.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    # both sides grow with the words; small shuffle files must not make one a broadcast
    used = pieces.hint("merge").join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    used = used.groupBy("source", "at").agg(F.sum(F.col("n") * F.col("times")).alias("taken"), F.sort_array(F.collect_list(F.struct(F.col("first").alias("start"), "n", "times"))).alias("pieces"))
    used = used.select(F.col("source").alias("s"), F.col("at").alias("a"), "taken", "pieces")
    # (source, at) names a document that has words
    out = rows.hint("merge").join(used.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & (F.col("size") > 0), "left")
    return out.select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.array()).alias("pieces"))


def mixed_texts(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix as texts: (row, copy, text). Copy c of a document holds the words
    that are taken c times or more: the text as it is if that is all of them,
    else those words with single spaces. Copies without words are left out."""
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_max(F.transform("pieces", lambda p: p["times"]).cast("array<int>"))))))
    copies = copies.withColumn("own", F.filter("pieces", lambda p: p["times"] >= F.col("copy"))).filter("size(own) > 0")
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda a, p: a + p["n"]) == F.col("size")
    found = F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.flatten(F.transform("own", lambda p: F.slice(found, (p["start"] + 1).cast("int"), p["n"].cast("int")))), " ")
    return copies.select("row", "copy", F.when(whole, F.col(f"row.`{text}`")).otherwise(part).alias("text"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """mix() of docs with their rows, for mixed_texts(): (row, size, pieces).

    Only keys and counts go through the mix; texts are moved once, to meet
    their pieces. Rows of one key and text are told apart by a running number;
    which of them takes which pieces does not matter."""
    crc = F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(-1))
    slim = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), crc.alias("crc"))
    copy = lambda s: F.row_number().over(Window.partitionBy("source", "key", "crc").orderBy(s))
    mixed = mix(slim, key="key", keep=["key", "crc", "source"]).select("row.*", "size", "pieces").filter("size(pieces) > 0")
    mixed = mixed.withColumn("copy", copy("size")).select(*(F.col(c).alias(f"m_{c}") for c in ("key", "crc", "source", "copy")), "size", "pieces")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), crc.alias("crc")).withColumn("copy", copy("crc"))
    same = F.col("copy") == F.col("m_copy")
    for c in ("key", "crc", "source"):
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    return rows.join(mixed.hint("merge"), same).select("row", "size", "pieces")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")
