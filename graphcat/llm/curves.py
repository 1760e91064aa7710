"""Nearest neighbours by shifted space-filling curves.

Vectors are projected by several random rotations to a few dimensions, shifted
and put in order along a Hilbert curve, one order for each rotation. A query's
candidates are the rows within a window of places on both sides of it in any
order. Orders are range-partitioned and cut into blocks of equal size; a query
goes to the blocks that its window touches. Candidates of all orders meet and
are ranked by the exact inner product.

The window's width is fitted: for a sample of queries the true neighbours are
found among all rows, and the width is what holds the wanted share of them in
at least one order. Vectors with little structure so get wide windows.

Equal vectors are searched once, as one class that stands for its smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read, written

ORDERS = 4
DIMENSIONS = 8  #: of a projection
BITS = 7  #: of a coordinate
BLOCK = 4096  #: places in a block
K = 20
EVERY = 20
SAMPLE = 128  #: queries, for the window's width
SCALE_SAMPLE = 10_000  #: rows, for the scale of projections
RECALL = 0.95
SEED = 11


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on a Hilbert curve of each row of non-negative integers below
    2**bits. Gray-code walk from the highest bit plane down, after Skilling."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(high, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[:, n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def rotations(size: int, orders: int = ORDERS, dimensions: int = DIMENSIONS, seed: int = SEED) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.standard_normal((size, min(size, dimensions))))[0] for _ in range(orders)]


def classes(vectors: DataFrame, id_column: str, vector: str, k: int, every: int) -> tuple[DataFrame, int]:
    """(class, v, ids, asks) for each distinct vector, and the vectors' size.

    class is the smallest id, ids the k + 1 smallest ones, asks whether some id
    is a query. Rows with a null id or vector, with a component that is null or
    not finite, of zeros only, or of another size than most, take no part.
    """
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return rows.select(F.col("id").alias("class"), "v", F.array("id").alias("ids"), F.lit(False).alias("asks")), 0
    # 0.0 and -0.0 are equal
    rows = rows.filter(F.size("v") == most["size"]).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    asks = rows.groupBy("v").agg(F.max(F.pmod("id", F.lit(every)) == 0).alias("asks"))
    # the rank's limit holds before the exchange too, so no class must meet whole
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    small = rows.distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return small.join(asks, "v").select(F.element_at("ids", 1).alias("class"), "v", "ids", "asks"), most["size"]


def _top(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n best of each row, ties to smaller ids; ids ascend."""
    if scores.shape[1] <= n:
        return np.argsort(-scores, axis=1, kind="stable")
    floor = np.partition(scores, scores.shape[1] - n, axis=1)[:, -n]
    out = np.empty((len(scores), n), dtype=np.int64)
    for r in range(len(scores)):
        some = np.flatnonzero(scores[r] >= floor[r])
        out[r] = some[np.argsort(-scores[r, some], kind="stable")[:n]]
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _brute(distinct: DataFrame, sample: DataFrame, n: int) -> DataFrame:
    """True neighbours (q, c) of sampled queries: every task keeps its best."""
    rows = sample.collect()  # at most SAMPLE
    ids, asked = np.array([r["class"] for r in rows]), np.array([r["v"] for r in rows])

    def look(batches):
        best: dict[int, list] = {int(q): [] for q in ids}
        for batch in batches:
            names = batch.column(0).to_numpy()
            s = asked @ _matrix(batch.column(1)).T
            for r, q in enumerate(ids.tolist()):
                top = np.argpartition(-s[r], min(n, s.shape[1]) - 1)[:n]
                best[q] = sorted(best[q] + list(zip((-s[r, top]).tolist(), names[top].tolist(), strict=True)))[:n]
        rows = [(q, c, -s) for q, x in best.items() for s, c in x]
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["q", "c", "s"])

    found = distinct.select("class", "v").mapInArrow(look, "q long, c long, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n).select("q", "c")


class Index:
    """All distinct vectors in several orders: placed has (order, place, class,
    v, asks)."""

    def __init__(self, distinct: DataFrame, size: int, orders: int = ORDERS):
        turn = rotations(size, orders)
        sample = np.array([r["v"] for r in distinct.select("v").orderBy(F.xxhash64("class")).limit(SCALE_SAMPLE).collect()])
        spread = [((sample @ t).mean(axis=0), np.maximum((sample @ t).std(axis=0), 1e-12)) for t in turn]
        shift = np.random.default_rng(SEED + 1).uniform(-0.5, 0.5, (orders, turn[0].shape[1]))

        def key(batches):
            for batch in batches:
                m = _matrix(batch.column(1))
                for o in range(orders):
                    mean, std = spread[o]
                    scaled = ((m @ turn[o] - mean) / std + shift[o]) / 7 + 0.5
                    cells = np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), o, dtype=np.int32)), pa.array(hilbert(cells, BITS)), *batch.columns], names=["o", "key", "class", "v", "asks"])

        def count(batches):
            at: dict[int, int] = {}
            for batch in batches:
                o, place = batch.column(0).to_numpy(), np.empty(len(batch), dtype=np.int64)
                for x in np.unique(o).tolist():
                    own = np.flatnonzero(o == x)
                    place[own] = at.get(x, 0) + np.arange(len(own))
                    at[x] = at.get(x, 0) + len(own)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=["o", "key", "class", "v", "asks", "part", "within"])

        keyed = distinct.select("class", "v", "asks").mapInArrow(key, "o int, key long, class long, v array<double>, asks boolean")
        ranged = keyed.repartitionByRange("o", "key", "class").sortWithinPartitions("o", "key", "class").withColumn("part", F.spark_partition_id())
        placed = written(ranged.mapInArrow(count, "o int, key long, class long, v array<double>, asks boolean, part int, within long"))
        # one row for each partition and order
        counts = placed.groupBy("o", "part").count()
        before = F.coalesce(F.sum("count").over(Window.partitionBy("o").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.placed = placed.join(counts.withColumn("before", before).drop("count"), ["o", "part"]).select("o", (F.col("before") + F.col("within")).alias("place"), "class", "v", "asks")

    def width(self, truth: DataFrame, recall: float) -> int:
        """The window that holds the wanted share of the pairs (q, c)."""
        at = self.placed.select("o", "place", "class")
        both = truth.join(at.select("o", F.col("place").alias("x"), F.col("class").alias("q")), "q").join(at.select("o", F.col("place").alias("y"), F.col("class").alias("c")), ["o", "c"])
        near = both.groupBy("q", "c").agg(F.min(F.abs(F.col("x") - F.col("y"))).alias("d"))
        return int(near.agg(F.percentile("d", F.lit(recall))).first()[0] or 0) + 1

    def candidates(self, width: int, n: int, block: int = BLOCK) -> DataFrame:
        """For each query class its n best (q, c). A block gives one row a query, with
        its best; these lists are merged by query."""
        rows = self.placed.withColumn("block", F.floor(F.col("place") / block))
        last = self.placed.agg(F.max("place")).first()[0] or 0
        touched = F.sequence(F.floor(F.greatest(F.col("place") - width, F.lit(0)) / block), F.floor(F.least(F.col("place") + width, F.lit(last)) / block))
        asked = self.placed.filter("asks").withColumn("block", F.explode(touched))

        def look(queries: pa.Table, own: pa.Table) -> pa.Table:
            if not len(queries) or not len(own):
                return lists([], [], [])
            names, place, m = own.column("class").to_numpy(), own.column("place").to_numpy(), _matrix(own.column("v"))
            order = np.argsort(names)
            names, place, m = names[order], place[order], m[order]
            q, at, v = queries.column("class_asked").to_numpy(), queries.column("place_asked").to_numpy(), _matrix(queries.column("v_asked"))
            b, d = [], []
            for i in range(0, len(q), 512):
                s = v[i : i + 512] @ m.T
                s[np.abs(at[i : i + 512][:, None] - place) > width] = -np.inf
                top = _top(s, names, n)
                best = np.take_along_axis(s, top, axis=1)
                for r, t in zip(best, top, strict=True):
                    good = r > -np.inf
                    b.append(names[t[good]])
                    d.append(r[good])
            return lists(q, b, d)

        def lists(q, near, scores) -> pa.Table:
            return pa.table({"q": pa.array(q, pa.int64()), "near": pa.array(near, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

        def merge(table: pa.Table) -> pa.Table:
            c, s = table.column("near").combine_chunks().flatten().to_numpy(), table.column("scores").combine_chunks().flatten().to_numpy()
            # a class found in several orders counts once
            c, first = np.unique(c, return_index=True)
            c = c[np.lexsort((c, -s[first]))[:n]]
            return pa.table({"q": pa.array(np.full(len(c), table.column("q")[0].as_py())), "c": pa.array(c)})

        asked = asked.select(*(F.col(c).alias(f"{c}_asked") for c in ("o", "block", "class", "place", "v")))
        return asked.groupBy("o_asked", "block_asked").cogroup(rows.select("o", "block", "class", "place", "v").groupBy("o", "block")).applyInArrow(look, "q long, near array<bigint>, scores array<double>").groupBy("q").applyInArrow(merge, "q long, c long")


def search(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, recall: float = RECALL, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query, by the
    inner product of the vectors, ties to smaller ids. Queries are the rows
    whose id is divisible by `every`; a query is no candidate of its own, other
    rows of the same vector are. Rows of one id and vector count once.
    """
    distinct, size = classes(vectors, id_column, vector, k, every)
    distinct = written(distinct)
    spark = vectors.sparkSession
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    sample = distinct.filter("asks").orderBy(F.xxhash64("class")).limit(SAMPLE)
    index = Index(distinct, size, orders)
    width = index.width(written(_brute(distinct, sample, k + 1)), recall)
    pairs = index.candidates(width, k + 4, block)
    v = distinct.select("class", "v", "ids")
    scored = pairs.join(v.select(F.col("class").alias("q"), F.col("v").alias("x")), "q").join(v.select(F.col("class").alias("c"), F.col("v").alias("y"), F.col("ids").alias("near")), "c")
    scored = scored.select("q", "c", "near", F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("score"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    scored = scored.withColumn("best", best).filter(F.col("best") <= k + 1)
    # from classes to rows: k + 1 ids of k + 1 classes at most
    each = scored.select("q", "score", F.explode("near").alias("id"))
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    lists = each.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("found"))
    asked = vectors.select(F.col(f"`{id_column}`").cast("long").alias("query_id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(F.pmod("query_id", F.lit(every)) == 0).distinct()
    asked = asked.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).join(distinct.select("class", "v"), "v").select("query_id", F.col("class").alias("q"))
    own = asked.join(lists, "q").withColumn("found", F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("f.id").alias("id"), F.col("f.score").alias("score"))


def op4_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
