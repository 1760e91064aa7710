"""Resharding by minimum-cost flow.

Documents lie in old shards, each dealt into blocks by a hash. Only the sizes
of the blocks go to the driver: at most old shards x blocks rows, whatever the
number of documents. A flow from the old shards' sizes to the new capacities,
at a cost of one for each byte that changes its shard, moves the fewest bytes.
The transfers are then made up of whole blocks.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read

SHARDS = 24
BLOCKS = 1024  #: blocks of an old shard


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes sent from each old to each new shard, by successive shortest paths
    with potentials. cost(i, j) is the price of a byte from i to j."""
    a, b = len(supply), len(capacity)
    source, sink = a + b, a + b + 1
    edges: list[list[int]] = []  # to, room, price; the twin of edge e is e ^ 1
    at: dict[int, list[int]] = defaultdict(list)

    def add(u: int, v: int, room: int, price: int) -> None:
        at[u].append(len(edges))
        edges.append([v, room, price])
        at[v].append(len(edges))
        edges.append([u, 0, -price])

    for i, n in enumerate(supply):
        add(source, i, n, 0)
    first = len(edges)
    for i in range(a):
        for j in range(b):
            add(i, a + j, supply[i], cost(i, j))
    for j, n in enumerate(capacity):
        add(a + j, sink, n, 0)
    potential = [0] * (a + b + 2)
    while True:
        far, via = {source: 0}, {}
        heap = [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in at[u]:
                v, room, price = edges[e]
                if room and (n := d + price + potential[u] - potential[v]) < far.get(v, float("inf")):
                    far[v], via[v] = n, e
                    heapq.heappush(heap, (n, v))
        if sink not in far:
            break
        for v, d in far.items():
            potential[v] += d
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        room = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= room
            edges[e ^ 1][1] += room
    return {(i, j): n for i in range(a) for j in range(b) if (n := edges[first + 2 * (i * b + j) + 1][1])}


def transfers(blocks: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """The new shard of each block (old shard, block, bytes)."""
    olds = max([shards, *(o + 1 for o, _, _ in blocks)])
    supply = [0] * olds
    for old, _, n in blocks:
        supply[old] += n
    total = sum(supply)
    target = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    quota = min_cost_flow(supply, target, lambda i, j: int(i != j))
    room, out = list(target), {}
    for old, block, n in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        planned = [j for j in range(shards) if quota.get((old, j), 0) > 0]
        fits = [j for j in planned if quota[old, j] >= n and room[j] >= n]
        j = max(fits, key=lambda j: (j == old, quota[old, j])) if fits else max(range(shards), key=lambda j: (room[j], j in planned))
        out[old, block] = j
        room[j] -= n
        quota[old, j] = quota.get((old, j), 0) - n
    return out


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def reshard(docs: DataFrame, old_shard: Column, key: Column, text: str = "text", shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """row (all columns), size, text_crc32, old_shard, shard and slot, gapless
    from 0 within a shard.

    key spreads the rows of an old shard over its blocks. A null text has 8
    bytes and checksum 0; a null old shard counts as 0. Repeated rows each have
    a slot. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), size_of(text).alias("size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).alias("text_crc32"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"), key.alias("_key"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(blocks)).cast("int"))
    sums = rows.groupBy("old_shard", "_block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    new = transfers([(r["old_shard"], r["_block"], r["bytes"]) for r in sums], shards)
    start: dict[int, int] = defaultdict(int)
    plan = []
    for r in sorted(sums, key=lambda r: (r["old_shard"], r["_block"])):
        shard = new[r["old_shard"], r["_block"]]
        plan.append((r["old_shard"], r["_block"], shard, start[shard]))
        start[shard] += r["n"]
    # at most old shards x blocks rows
    plan_df = F.broadcast(docs.sparkSession.createDataFrame(plan, "old_shard int, _block int, shard int, _start long"))
    within = Window.partitionBy("old_shard", "_block").orderBy("_key", "text_crc32", "size")
    return rows.withColumn("_k", F.row_number().over(within)).join(plan_df, ["old_shard", "_block"]).select("row", "size", "text_crc32", "old_shard", "shard", (F.col("_start") + F.col("_k") - 1).alias("slot"))


def affected(placed: DataFrame) -> DataFrame:
    """Shards whose files change: they get rows from elsewhere or give rows away."""
    moved = placed.filter("shard <> old_shard")
    return moved.select("shard").union(moved.select("old_shard")).distinct()


def rewrite(placed: DataFrame, path: str) -> None:
    """Writes the affected shards anew, one folder each; others stay as they are.
    A task sorts by shard, so it has one open file at a time."""
    rows = placed.join(F.broadcast(affected(placed)), "shard", "left_semi")
    salted = rows.repartition("shard", F.col("slot") % 64).sortWithinPartitions("shard", "slot")
    salted.select("row.*", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def old_shard_of_source(source: str = "source") -> Column:
    """The layout before: all documents of a source in one shard."""
    return F.pmod(F.crc32(F.coalesce(F.col(source), F.lit("")).cast("binary")), F.lit(SHARDS))


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed = reshard(docs, old_shard_of_source(), F.col("doc_id"))
    return placed.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
