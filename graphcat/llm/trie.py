"""Prefix trie of conversations by digests of blocks of turns.

Conversations are cut into blocks of four turns. A block's key is told from the
digests of all blocks up to it, so conversations that agree up to a block's end
share its key; groups of these keys are the trie in steps of four turns. Only
below a group with several next blocks are the turns of these blocks, each
block once however many conversations have it, told apart one by one. A block
without siblings gives its turns' nodes as it is.

What a node says of its subtree needs no walk. A node belongs to its smallest
member, and a conversation's own nodes are the last ones of its path. So a
subtree's leaves are those of its members whose path ends in a leaf of their
own, and its saved characters are, summed over its members, the characters
between the node and the member's first own node: both are sums over members,
made over (conversation, block) rows.

Conversations and groups of any size are split: turns are numbered in ranges of
turns, prefixes add up in two levels, ids of a node's ends go to its digest in
packed rows of 8192 numbers at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read, written

BLOCK = 4  #: turns a block
LEVEL = 1024  #: blocks of a conversation that one running sum covers
ENDS_BITS = 13  #: ids are packed in ranges of so many bits


def _root() -> Column:
    """The key of the node without turns."""
    return F.lit(bytearray())


def _md5(column: Column) -> Column:
    return F.unhex(F.md5(column))


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, i, digest, chars): each turn's place in its conversation from 1, a
    digest of role and text and the text's code points.

    Turns go by turn (null first), then by role, then by the digest. Null role
    or text count as empty. Rows without a conversation are left out.
    """
    said, what = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = turns.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), said.alias("role"),
        F.length(what).cast("long").alias("chars"), _md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, what).cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("tie"),
    )
    order = ["turn", "role", "digest", "tie"]
    ranged = written(rows.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    places = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))
    # only a conversation that goes over from one range to the next has turns before a range:
    # at most one row a range
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("before", before).filter("before > 0").select("conv", "part", "before")
    placed = ranged.withColumn("place", places).join(F.broadcast(starts), ["conv", "part"], "left")
    return placed.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("i"), "digest", "chars")


def rebuilt(turns: DataFrame, of: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations and their turns (as of ordered()) after each has taken the
    first h turns of the first conversation of its hundred in place of its own
    first h; h is its id's CRC-32 modulo six. (conv) and (conv, i, digest, chars)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv").agg(F.least(F.max("i"), F.lit(most - 1)).alias("n"))
    heads = turns.filter(F.col("i") < most).withColumnRenamed("conv", "base")
    took = convs.select("conv", (F.col("conv") - F.col("conv") % of).alias("base"), h.alias("h"))
    took = took.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("has")), "base", "left").withColumn("m", F.least("h", F.coalesce("has", F.lit(0))))
    # at most five turns of one base for at most 199 conversations
    first = took.join(heads, "base").filter("i <= m").select("conv", "i", "digest", "chars")
    own = turns.filter(F.col("i") > h).join(took, "conv").select("conv", (F.col("i") - F.col("h") + F.col("m")).cast("long").alias("i"), "digest", "chars")
    return convs.select("conv"), first.unionByName(own)


def blocks_of(turns: DataFrame) -> DataFrame:
    """(conv, k, key, above, turns, before): a row for each block of each
    conversation, its key, that of the block before it, its turns and the code
    points of all turns before it."""
    packed = turns.groupBy("conv", F.expr(f"(i - 1) div {BLOCK}").alias("k")).agg(F.sort_array(F.collect_list(F.struct("i", "digest", "chars"))).alias("turns"))
    packed = packed.withColumn("own", _md5(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "").cast("binary")))
    sums = {"a": F.xxhash64(F.lit(1), "k", "own").cast("decimal(20,0)"), "b": F.xxhash64(F.lit(2), "k", "own").cast("decimal(20,0)"), "c": F.aggregate(F.col("turns.chars"), F.lit(0).cast("long"), lambda s, x: s + x)}
    rows = packed.select("conv", "k", F.expr(f"k div {LEVEL}").alias("level"), F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"), *(v.alias(n) for n, v in sums.items()))
    upto = Window.partitionBy("conv", "level").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    levels = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy("conv", "level").agg(*(F.sum(n).alias(n) for n in sums))
    lower = total.select("conv", "level", *(F.sum(n).over(levels).alias(f"{n}_lower") for n in sums)).filter("level > 0")
    summed = rows.select("*", *(F.sum(n).over(upto).alias(f"{n}_upto") for n in sums)).join(lower, ["conv", "level"], "left")
    whole = {n: F.col(f"{n}_upto") + F.coalesce(F.col(f"{n}_lower"), F.lit(0)) for n in sums}
    key = lambda k, a, b: _md5(F.concat_ws(":", k.cast("string"), a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string")).cast("binary"))
    return summed.select("conv", "k", key(F.col("k"), whole["a"], whole["b"]).alias("key"), F.when(F.col("k") == 0, _root()).otherwise(key(F.col("k") - 1, whole["a"] - F.col("a"), whole["b"] - F.col("b"))).alias("above"), "turns", (whole["c"] - F.col("c")).cast("long").alias("before"))


def _each_turn(groups: DataFrame, *columns: str) -> DataFrame:
    """The turns of groups of blocks: id, parent, depth, chars of the turn, before it,
    the group's key where its block ends, and columns of the group."""
    rows = groups.select("k", "key", "above", "turns", F.col("before").alias("start"), *columns, F.posexplode("turns").alias("j", "turn"))
    inner = lambda n: _md5(F.concat(F.hex("above"), F.lit(":"), n.cast("string"), F.lit(":"), F.array_join(F.transform(F.slice("turns", 1, n), lambda x: F.hex(x["digest"])), "")).cast("binary"))
    j = F.col("j") + 1
    return rows.select(
        F.when(j == BLOCK, F.col("key")).otherwise(inner(j)).alias("id"),
        F.when(j == 1, F.col("above")).otherwise(inner(F.col("j"))).alias("parent"),
        (F.col("k") * BLOCK + j).alias("depth"),
        F.col("turn.chars").alias("chars"),
        (F.col("start") + F.aggregate(F.slice("turns", 1, F.col("j"))["chars"], F.lit(0).cast("long"), lambda s, x: s + x)).alias("before"),
        F.when(j == F.size("turns"), F.col("key")).alias("ends"),
        *columns,
    )


def _digests(ends: DataFrame) -> DataFrame:
    """(ends, sha): SHA-256 of the ids that end at a key, in order. Packed rows
    of a key come one after the other, and pass through one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for k, ids in zip(batch.column("ends").to_pylist(), batch.column("ids"), strict=True):
                if k != key:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done])], names=["ends", "sha"])
                done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["ends", "sha"])

    packed = ends.groupBy("ends", F.shiftright("conv", ENDS_BITS).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    return packed.repartition("ends").sortWithinPartitions("ends", "part").select("ends", "ids").mapInArrow(run, "ends binary, sha string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, all of a node.

    convs has one row a conversation (conv), also for those without turns; turns
    is as of ordered() or rebuilt(). Equal conversations share a path. No
    conversations give no rows; conversations without turns only give the root.
    """
    convs = written(convs)
    blocks = written(blocks_of(turns))
    groups = written(blocks.groupBy("key").agg(*(F.first(c).alias(c) for c in ("k", "above", "turns", "before")), F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")))
    nexts = groups.groupBy("above").agg(F.count("*").alias("siblings"))
    split = groups.join(nexts, "above")

    def of_turns(groups: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
        """Nodes of all groups: a turn of a block without siblings is a node; of
        blocks with siblings, equal turns after equal ones are one. values: a
        column of a node by a block's turn, and how those of several blocks are one."""
        made = ["id", "parent", "depth", "chars", "before", "ends"]
        each = _each_turn(groups, "siblings", *(c for c in groups.columns if c not in ("k", "key", "above", "turns", "before", "siblings")))
        each = each.select(*made, "siblings", *(v.alias(n) for n, (v, _) in values.items()))
        alone = each.filter("siblings = 1").select(*made, *values)
        several = each.filter("siblings > 1").groupBy("id").agg(*(F.max(c).alias(c) for c in made[1:]), *(f.alias(n) for n, (_, f) in values.items()))
        return alone.unionByName(several)

    sums = {"n_convs": (F.col("n_convs"), F.sum("n_convs")), "conv_id": (F.col("conv_id"), F.min("conv_id"))}
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(_root().alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("before"), _root().alias("ends"), "n_convs", "conv_id")
    nodes = of_turns(split, sums).unionByName(root)
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "id", "left").fillna(0, ["n_children"]))

    # a conversation's first own node, whether its last one is a leaf of its own, and the characters before the first
    own = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("first"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min_by("before", "depth").alias("shared"))
    whole = F.col("before") + F.aggregate(F.col("turns.chars"), F.lit(0).cast("long"), lambda s, x: s + x)
    last = blocks.groupBy("conv").agg(F.max(whole).alias("whole"), F.max_by("key", "k").alias("ends"))
    members = convs.join(last, "conv", "left").join(own, "conv", "left").select(
        "conv", F.coalesce("ends", _root()).alias("ends"), F.coalesce("first", F.lit(1 << 60)).alias("first"), F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("shared", "whole", F.lit(0)).alias("shared"),
    )
    members = written(members)

    start, end = F.col("k") * BLOCK, F.col("k") * BLOCK + F.size("turns")
    later, here = F.col("first") > end, (F.col("first") > start) & (F.col("first") <= end)
    of_block = blocks.join(members.drop("ends"), "conv").groupBy("key").agg(
        F.sum(F.when(later, F.col("shared")).otherwise(0)).alias("shared"), F.sum(later.cast("long")).alias("more"),
        F.max(F.when(here, F.col("first"))).alias("first"), F.max(F.when(here, F.col("shared"))).alias("first_shared"), F.sum("leaf").alias("leaves"),
    )
    saved = F.col("shared") - F.col("more") * F.col("before") + F.when(F.col("depth") < F.col("first"), F.col("first_shared") - F.col("before")).otherwise(0)
    sub = of_turns(split.drop("n_convs", "conv_id").join(of_block, "key"), {"n_leaves": (F.col("leaves"), F.sum("n_leaves")), "saved_tokens": (saved, F.sum("saved_tokens"))}).select("id", "n_leaves", "saved_tokens")
    of_root = members.agg(F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens")).filter("n_leaves IS NOT NULL").select(_root().alias("id"), "n_leaves", "saved_tokens")

    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sub.unionByName(of_root), "id").join(parents, "parent", "left").join(_digests(members.select("ends", "conv")), "ends", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(_root(), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered(read(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH RECURSIVE placed AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT DISTINCT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS x FROM placed
  UNION ALL
  SELECT c, s, k + 1, CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(x, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE x END AS y FROM bits WHERE k < 8 * length(s))
), convs AS (
  SELECT c, c - c % 100 AS base, xor(x, 4294967295::BIGINT) % 6 AS h FROM bits WHERE k = 8 * length(s)
), taken AS (
  SELECT convs.c, 0 AS own, p.i, p.r, p.t FROM convs JOIN placed p ON p.c = convs.base AND p.i <= convs.h
  UNION ALL
  SELECT convs.c, 1, p.i, p.r, p.t FROM convs JOIN placed p ON p.c = convs.c AND p.i > convs.h
), steps AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, length(t) AS chars, md5(length(r) || ':' || r || t) AS one FROM taken
), paths AS (
  SELECT c, d, chars, md5(string_agg(one, ',') OVER (PARTITION BY c ORDER BY d)) AS id, string_agg(one, ',') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM steps
), visits AS (
  SELECT c, 0 AS d, 0 AS chars, '' AS id, NULL::VARCHAR AS parent FROM convs
  UNION ALL
  SELECT c, d, chars, id, CASE WHEN d = 1 THEN '' ELSE md5(up) END FROM paths
), lengths AS (
  SELECT c, max(d) AS len FROM visits GROUP BY c
), nodes AS (
  SELECT v.id, v.d, min(v.parent) AS parent, min(v.c) AS conv_id, count(*) AS n_convs, max(v.chars) AS chars,
    string_agg(CASE WHEN l.len = v.d THEN v.c::VARCHAR END, ',' ORDER BY v.c) AS ends
  FROM visits v JOIN lengths l ON l.c = v.c GROUP BY v.id, v.d
), children AS (
  SELECT parent AS id, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), under AS (
  SELECT a.id, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n LEFT JOIN children k ON k.id = n.id JOIN visits own ON own.c = n.conv_id AND own.d = n.d
  JOIN visits a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.id
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.n_leaves::BIGINT AS n_leaves,
  u.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN under u ON u.id = n.id LEFT JOIN nodes p ON p.id = n.parent LEFT JOIN children k ON k.id = n.id
"""
