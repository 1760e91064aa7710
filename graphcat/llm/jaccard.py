"""Jaccard join of shingle sets by token-combination prefixes.

1. Every document's set of shingles gets a fingerprint; documents of equal sets
   are one class, and only classes are joined.
2. A count sketch over all documents orders shingles from rare to frequent and
   deals them into frequency classes 1, 2 and 3. Any order that is the same
   for all documents gives whole results; the sketch only makes it a good one.
3. A set's prefix is read in that order until it must hold a key in common with
   every similar set. A rare shingle is a key; of frequent ones, dealt into
   groups, pairs (class 2) or triples (class 3) of one group are. If e shingles
   of a prefix are missing in the other set and a group of class k has n of
   them, the other set shares k of them unless e takes n - k + 1 away; so the
   prefix grows until the sum of n - k + 1 over all groups is above the number
   of shingles that a similar set can lack. The number of groups goes by the
   power of two below a set's size; a set that can be similar to one below the
   next smaller power has the keys of that, too.
4. Keys that only one set has are left out by packed exchanges (see runs), and
   the rest becomes rows.
5. Sets that share a key are verified against one of them, the most typical,
   not pair by pair. Pairs that share a key and are not connected by what was
   found so far are then verified, too, so no link between components is lost.
   Where a pivot has many sets, they are compared by what each differs in from
   the pivot: two of them are similar if what they differ in has enough in
   common, and that is a prefix-filtered join of its own, with the shingles
   that the pivot lacks before those that it has.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .components import connected
from .runs import bucketed, cuts, ranges, unpacked
from .tables import carried, discard, read, written

SHINGLE = 3
PERCENT = 90
SKETCH = 1 << 20
CHUNK = 1 << 14
#: Shingles of a group at least, where all of a set's are of one class.
GROUP = 8
LEAST_PERCENT = 40  #: below that a set can have too few shingles for its groups
#: A pivot whose keys so many sets hold is large: its sets are compared by what
#: they differ in from it.
LARGE = 256
#: Prefixes go on for so many keys that similar sets share, through rare shingles.
SHARED = 4
FREQUENT, COMMON = 8, 1024  #: above the sketch's mean load and its noise
PART = 1 << 12  #: sets whose keys are packed together
SUMMED = 64  #: parts of the sketch that are summed in one group


def sets(column: pa.Array, n: int):
    """For each row of a column, the sorted distinct hashes of its shingles."""
    for part in W.split(column, W.NOT_SPACE):
        h = part.hashes()
        full = W.shingles(h, part.first, n)
        for r in range(part.rows):
            a, b = part.first[r], part.first[r + 1]
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            elif b > a:
                yield W.shingles(h[a:b], np.array([0, b - a]), int(b - a))[:1]
            else:
                yield np.zeros(0, dtype=np.uint64)


def fingerprint(shingles: np.ndarray) -> int:
    """Of a set: the same for equal sets, by 64 bits otherwise different."""
    both = np.array([W.mix(shingles + np.uint64(11)).sum(dtype=np.uint64) + np.uint64(len(shingles))])
    return int(W.mix(both).view(np.int64)[0])


def _facts(docs: DataFrame, n: int) -> DataFrame:
    """docs (row, text, id) to (row, id, n, set), and the sketch's parts of each
    task, by chunk."""

    def look(batches):
        counts = np.zeros(SKETCH, dtype=np.int64)
        empty, names = None, ["row", "id", "n", "set", "chunk", "of", "counts"]
        for batch in batches:
            empty = batch.column(0).slice(0, 0)
            sizes, prints = [], []
            for s in sets(batch.column(1), n):
                sizes.append(len(s))
                prints.append(fingerprint(s))
                np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            rows = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if empty is not None:
            parts = [c for c in range(SKETCH // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
            m = len(parts)
            blobs = [zlib.compress(counts[c * CHUNK : (c + 1) * CHUNK].tobytes(), 1) for c in parts]
            task = pa.array([TaskContext.get().partitionId()] * m, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(m, empty.type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(parts, pa.int32()), task, pa.array(blobs, pa.binary())], names=names)

    row = T.StructField("row", docs.schema["row"].dataType, True)
    schema = T.StructType([row, *T._parse_datatype_string("id long, n long, set long, chunk int, of int, counts binary").fields])
    return docs.select("row", "text", "id").mapInArrow(look, schema)


def _sketch(facts: DataFrame) -> np.ndarray:
    """The summed sketch: SKETCH counters, whatever the number of documents.
    Its noise grows with the square root of what a counter holds."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.int64)
        for b in table.column("counts"):
            total += np.frombuffer(zlib.decompress(b.as_buffer()), dtype=np.int64)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "of": table.column("of").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = facts.filter("chunk IS NOT NULL").select("chunk", "of", "counts")
    # sums of SUMMED tasks first, so that no group has the parts of all
    some = parts.withColumn("of", F.floor(F.col("of") / SUMMED).cast("int")).groupBy("chunk", "of").applyInArrow(add, "chunk int, of int, counts binary")
    out = np.zeros(SKETCH, dtype=np.int64)
    for r in some.withColumn("of", F.lit(0)).groupBy("chunk").applyInArrow(add, "chunk int, of int, counts binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
    return out


def can_link(n: int, percent: int) -> bool:
    """Whether a set of this size can be similar to one that is not equal to it."""
    return n * 100 // percent > n or -(-percent * n // 100) < n


def _combined(h: list[int], kind: list[int], lacks: int, groups: int) -> tuple[list[np.ndarray], int]:
    """Keys of the prefix of a set's shingles, in order, and how many of them a
    similar set has at least."""
    held: dict[tuple[int, int], list[int]] = {}
    single, covered = [], 0
    for x, k in zip(h, kind, strict=True):
        if covered > lacks and (k > 1 or covered >= lacks + SHARED):
            break
        if k == 1:
            single.append(x)
            covered += 1
            continue
        own = held.setdefault((k, (x >> 7) % groups), [])
        own.append(x)
        covered += len(own) >= k
    out = [W.mix(np.array(single, dtype=np.uint64) ^ np.uint64(0xB1))]
    for (k, _), own in held.items():
        if len(own) >= k:
            combos = np.array(list(combinations(sorted(own), k)), dtype=np.uint64)
            key = np.full(len(combos), 0xB0 + k, dtype=np.uint64) + np.uint64(groups << 8)
            for c in range(k):
                key = W.mix(key * np.uint64(3) + combos[:, c])
            out.append(key)
    return out, covered - lacks


def ordered(shingles: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    """Indices of a set's shingles from rare to frequent."""
    return np.lexsort((shingles, estimate))


def keys_of(shingles: np.ndarray, estimate: np.ndarray, frequent: int, common: int, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The keys of a set's prefixes, and how many of them a similar set whose own
    prefix does not end before has at least."""
    n = len(shingles)
    order = ordered(shingles, estimate)
    h, est = shingles[order], estimate[order]
    lacks = n - -(-percent * n // 100)
    kind = (1 + (est >= frequent) + (est >= common)).tolist()
    words = h.tolist()
    out, least = [], SHARED
    power = 1 << (n.bit_length() - 1)
    # sets so small that their groups could be left without a combination
    few = 300 // percent
    if n * percent <= 100 * few:
        out.append(W.mix(h[: lacks + 1] ^ np.uint64(0xA1)))
        least = 1
    for p in (power, power // 2):
        # the smaller power for the sake of similar sets below this one
        if p and (p == power or (percent * n <= 100 * power and max(kind) > 1)):
            keys, k = _combined(words, kind, lacks, max(1, p // GROUP))
            out += keys
            least = min(least, k)
    return np.unique(np.concatenate(out)), max(1, least)


def _prefixes(docs: DataFrame, sketch: np.ndarray, shared, n: int, percent: int) -> DataFrame:
    """One row per class that can have a similar one: (set, n, typical, least, keys)."""
    load = sketch.sum() / SKETCH
    floor = int(load + 6 * load**0.5)

    def cut(batches):
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for s in sets(batch.column(0), n):
                f = fingerprint(s)
                if f in seen or not can_link(len(s), percent):
                    continue
                seen.add(f)
                est = shared.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                keys, least = keys_of(s, est, floor + FREQUENT, floor + COMMON, percent)
                rows.append((f, len(s), int(est.min()), least, keys.view(np.int64)))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["set", "n", "typical", "least", "keys"])

    return docs.filter("id IS NOT NULL").select("text").mapInArrow(cut, "set long, n long, typical long, least long, keys array<bigint>").dropDuplicates(["set"])


def _fits(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _full(wanted: DataFrame, docs: DataFrame, one_of_each: DataFrame, n: int, shared) -> DataFrame:
    """(set, shingles) of the wanted sets (set); shingles from rare to frequent."""

    def look(batches):
        for batch in batches:
            prints, out = [], []
            for s in sets(batch.column(0), n):
                prints.append(fingerprint(s))
                out.append(s[ordered(s, shared.value[(s & np.uint64(SKETCH - 1)).astype(np.int64)])].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["set", "shingles"])

    ids = wanted.distinct().join(one_of_each, "set").select("id")
    texts = docs.select("id", "text").join(ids, "id", "left_semi").select("text")
    return written(texts.mapInArrow(look, "set long, shingles array<bigint>").dropDuplicates(["set"]))


def _held_by_several(prefixes: DataFrame, parts: int) -> DataFrame:
    """(key, set, n, typical, least) for the keys of prefixes (part, set, n,
    typical, least, keys) that several sets have, and a few more."""
    n = ranges(parts)

    def unique(table: pa.Table):
        lists = table.column("keys").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return np.unique(flat, return_inverse=True, return_counts=True), np.diff(lists.offsets.to_numpy())

    def tell(table: pa.Table) -> pa.Table:
        (h, _, counts), _ = unique(table)
        at, own = cuts(h, n), table.column("part")[0].as_py()
        packed = np.ascontiguousarray(h.astype(">u8")[:, None].view(np.uint8)[:, :6])
        spans = [(int(r), at[r], at[r + 1]) for r in np.flatnonzero(np.diff(at))]
        return pa.table({"range": pa.array([r for r, _, _ in spans], pa.int32()), "part": pa.array([own] * len(spans), pa.int32()), "keys": pa.array([packed[a:b].tobytes() for _, a, b in spans], pa.binary()), "several": pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in spans], pa.binary())})

    def combine(table: pa.Table) -> pa.Table:
        packed = [k.reshape(-1, 6) for k in unpacked(table.column("keys"), np.uint8)]
        sizes = [len(k) for k in packed]
        keys = np.zeros((sum(sizes), 8), dtype=np.uint8)
        keys[:, 2:] = np.concatenate(packed)
        several = np.concatenate([np.unpackbits(b, count=k) for b, k in zip(unpacked(table.column("several"), np.uint8), sizes, strict=True)])
        _, inverse, counts = np.unique(keys.view(">u8").ravel().astype(np.uint64), return_inverse=True, return_counts=True)
        held = counts > 1
        held[inverse[several > 0]] = True
        return pa.table({"range": table.column("range"), "part": table.column("part"), "held": pa.array([np.packbits(p).tobytes() for p in np.split(held[inverse], np.cumsum(sizes)[:-1])], pa.binary()), "n": pa.array(sizes, pa.int32())})

    def keep(table: pa.Table, answers: pa.Table) -> pa.Table:
        facts = ("set", "n", "typical", "least")
        if not len(table):
            return pa.table({c: pa.array([], pa.int64()) for c in ("key", *facts)})
        (h, inverse, _), sizes = unique(table)
        bits = [np.unpackbits(b, count=k) for b, k in zip(unpacked(answers.column("held"), np.uint8), answers.column("n").to_pylist(), strict=True)]
        held = np.concatenate([bits[i] for i in np.argsort(answers.column("range").to_numpy())]) if bits else np.zeros(0, np.uint8)
        some = np.flatnonzero(held[inverse])
        row = np.repeat(np.arange(len(table)), sizes)[some]
        return pa.table({"key": h[inverse[some]].view(np.int64), **{c: table.column(c).to_numpy()[row] for c in facts}})

    told = prefixes.groupBy("part").applyInArrow(tell, "range int, part int, keys binary, several binary")
    answers = written(told.groupBy("range").applyInArrow(combine, "range int, part int, held binary, n int"))
    return prefixes.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(keep, "key long, set long, n long, typical long, least long")


def _similar(same, total, percent: int):
    """Whether sets of so many shingles together have so many in common."""
    return same * 100 >= (total - same) * percent


def _compared(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """pairs (a, b) with both sets' shingles, x and y."""
    side = lambda c, x: full.select(F.col("set").alias(c), F.col("shingles").alias(x))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar."""
    same = F.size(F.array_intersect("x", "y"))
    return _compared(pairs, full).filter(_similar(same, F.size("x") + F.size("y"), percent)).select("a", "b")


def settled_pairs(shared: DataFrame) -> DataFrame:
    """(a, b, pivot_n, n, large): each pivot with the other sets of its keys, and
    whether these are many."""
    around = shared.filter("set <> pivot").select(F.col("pivot").alias("a"), F.col("set").alias("b"), "pivot_n", "n").distinct()
    many = around.groupBy("a").count().filter(F.col("count") >= LARGE).select("a", F.lit(True).alias("large"))
    return written(around.join(many, "a", "left").withColumn("large", F.coalesce("large", F.lit(False))))


def _members(wide: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, set, n, apart, f): for each set around a large pivot a, the pivot
    itself among them, what it differs in, shingles that the pivot lacks first.

    f = |apart| * (100 + percent) - n * (100 - percent). Two sets are similar if
    2 * (100 + percent) * (what their aparts have in common) >= f + f.
    """
    sides = _compared(wide.select("a", "b"), full)
    apart = F.concat(F.array_except("y", "x"), F.array_except("x", "y"))
    rows = sides.select("a", F.col("b").alias("set"), F.size("y").alias("n"), apart.alias("apart"))
    pivots = wide.select("a", F.col("a").alias("set"), F.col("pivot_n").cast("int").alias("n"), F.array().cast("array<bigint>").alias("apart")).distinct()
    return written(rows.union(pivots).withColumn("f", F.size("apart") * (100 + percent) - F.col("n") * (100 - percent)))


def _least_f(members: DataFrame) -> DataFrame:
    """(a, best, f_best): of each pivot, the set with the smallest f."""
    return members.groupBy("a").agg(F.min(F.struct("f", "set")).alias("low")).select("a", F.col("low.set").alias("best"), F.col("low.f").alias("f_best"))


def _certain(members: DataFrame) -> DataFrame:
    """Links (a, b) that need nothing in common: f + f <= 0. The set with the
    smallest f is in such a link with each set that is in any, so these connect
    them all."""
    return members.join(_least_f(members), "a").filter("f + f_best <= 0 AND set <> best").select(F.col("best").alias("a"), F.col("set").alias("b"))


def _between(members: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """The other links (a, b) of sets of one large pivot and different groups.

    Of two sets, the one with the smaller f needs f / (100 + percent) in common
    with the other, that one half of its f and the pivot's smallest; so the
    first shingles of both have one in common.
    """
    scale = 100 + percent
    placed = members.join(group, "set", "left").withColumn("g", F.coalesce("g", "set"))
    mixed = placed.groupBy("a").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.min("f").alias("f_best")).filter("low <> high")
    rows = written(placed.join(mixed.select("a", "f_best"), "a"))
    size = F.size("apart")
    first = lambda need: F.posexplode(F.slice("apart", 1, F.greatest(F.lit(0), size - F.greatest(F.lit(1), F.ceil(need).cast("int")) + 1)))
    side = lambda need, c: rows.select("a", first(need).alias("p", "shingle"), size.alias("m"), "set", "n", "g", "f").select("a", "shingle", *(F.col(k).alias(f"{k}_{c}") for k in ("p", "m", "set", "n", "g", "f")))
    x, y = side(F.col("f") / scale, "x"), side((F.col("f") + F.col("f_best")) / (2 * scale), "y")
    before = (F.col("f_x") < F.col("f_y")) | ((F.col("f_x") == F.col("f_y")) & (F.col("set_x") < F.col("set_y")))
    # what follows the first shingle in common bounds what is in common
    most = F.least(F.col("m_x") - F.col("p_x"), F.col("m_y") - F.col("p_y"))
    found = x.join(y, ["a", "shingle"]).filter((F.col("g_x") != F.col("g_y")) & before & _fits("n_x", "n_y", percent) & (2 * scale * most >= F.col("f_x") + F.col("f_y")))
    pairs = written(found.select("a", "set_x", "set_y").distinct())
    side = lambda c: rows.select("a", F.col("set").alias(f"set_{c}"), F.col("apart").alias(f"apart_{c}"), F.col("f").alias(f"f_{c}"))
    both = pairs.join(side("x"), ["a", "set_x"]).join(side("y"), ["a", "set_y"])
    similar = 2 * scale * F.size(F.array_intersect("apart_x", "apart_y")) >= F.col("f_x") + F.col("f_y")
    return both.filter(similar).select(F.col("set_x").alias("a"), F.col("set_y").alias("b"))


def join_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id", keep: list[str] | None = None, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """row (the carried columns), n_shingles, set (the class), component (the
    smallest id that links lead to, the own id included) and linked (the same for
    all rows that links connect, and for no others; null if nothing can be linked).

    Sets with percent% of their union in common are linked. A null or wordless
    text has the empty set and no link. Rows of equal sets are of one class. A
    row without id is linked with nothing and has a null component.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be {LEAST_PERCENT} or more")
    docs = carried(docs, text, keep).withColumn("id", F.col(f"row.`{id_column}`"))
    facts = written(_facts(docs, n))
    rows = facts.filter("chunk IS NULL").select("row", "id", "n", "set")
    classes = rows.filter("id IS NOT NULL AND n > 0").groupBy("set").agg(F.min("id").alias("id"))
    sketch = _sketch(facts)
    estimates = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))
    parts = max(1, -(-facts.filter("n > 0").count() // PART))
    prefixes = _prefixes(docs, sketch, estimates, n, percent).withColumn("part", F.pmod("set", F.lit(parts)).cast("int"))
    held = _held_by_several(bucketed(prefixes, parts, "part"), parts)
    each = written(held)
    discard(held)
    heads = each.groupBy("key").agg(F.count("*").alias("held"), F.max(F.struct("typical", "set", "n")).alias("pivot")).filter("held > 1")
    shared = written(each.join(heads, "key").select("key", "set", "n", "least", F.col("pivot.set").alias("pivot"), F.col("pivot.n").alias("pivot_n")))
    discard(each)
    around = settled_pairs(shared)
    own = written(shared.groupBy("set").agg(F.max("least").alias("least"), F.collect_set("key").alias("keys")))
    side = lambda c: own.select(F.col("set").alias(c), F.col("least").alias(f"least_{c}"), F.col("keys").alias(f"keys_{c}"))
    # similar sets share so many keys; that is settled before any set is moved
    enough = F.size(F.array_intersect("keys_a", "keys_b")) >= F.least("least_a", "least_b")
    stars = around.filter("NOT large").filter(_fits("n", "pivot_n", percent)).select("a", "b")
    stars = written(stars.join(side("a"), "a").join(side("b"), "b").filter(enough).select("a", "b"))
    wide = around.filter("large").select("a", "b", "n", "pivot_n")
    wanted = stars.select(F.col("a").alias("set")).union(stars.select("b")).union(wide.select("a")).union(wide.select("b"))
    full = _full(wanted, docs, classes, n, estimates)
    members = _members(wide, full, percent)
    links = written(_verified(stars, full, percent).union(_certain(members)))
    discard(full, stars)
    group = connected(links).select(F.col("node").alias("set"), F.col("component").alias("g"))
    between = _between(members, group, percent)
    found, links = links, written(links.union(between))
    discard(between, members, found)
    # the same for keys of other pivots; these hold fewer than LARGE sets
    others = shared.join(around.filter("large").select(F.col("a").alias("pivot")).distinct(), "pivot", "left_anti")
    placed = written(others.join(group, "set", "left").withColumn("g", F.coalesce("g", "set")))
    discard(shared, around)
    of_key = placed.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.max(F.when(F.col("set") == F.col("pivot"), F.col("g"))).alias("home"))
    named = written(placed.join(of_key.filter("low <> high").select("key", "home"), "key").select("key", "set", "n", "least", "g", "home", (F.col("set") == F.col("pivot")).alias("is_pivot")))
    discard(placed)
    # two sets in no pair so far and of different groups share only such keys
    mixed = named.groupBy("set").agg(F.collect_set("key").alias("keys"))
    named = named.drop("least").join(mixed.join(own.select("set", "least"), "set"), "set")
    x = named.filter("g <> home").select("key", *(F.col(c).alias(f"{c}_x") for c in ("set", "n", "g", "least", "keys")))
    y = named.filter("NOT is_pivot").select("key", "home", *(F.col(c).alias(f"{c}_y") for c in ("set", "n", "g", "least", "keys")))
    once = (F.col("g_y") == F.col("home")) | (F.col("set_x") < F.col("set_y"))
    common = F.array_intersect("keys_x", "keys_y")
    rest = x.withColumnRenamed("key", "k_x").join(y, (F.col("k_x") == F.col("key")) & (F.col("g_x") != F.col("g_y")) & once & _fits("n_x", "n_y", percent) & (F.size(common) >= F.least("least_x", "least_y")))
    pairs = written(rest.select(F.col("set_x").alias("a"), F.col("set_y").alias("b")).distinct())
    discard(named, own)
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b"))
    links = links.unionByName(_verified(pairs, _full(wanted, docs, classes, n, estimates), percent))
    groups = connected(written(links))
    # every class with its component's smallest id
    placed = classes.join(groups.select(F.col("node").alias("set"), F.col("component").alias("g")), "set", "left").withColumn("g", F.coalesce("g", "set"))
    low = placed.groupBy("g").agg(F.min("id").alias("low"))
    ids = placed.join(low, "g").select("set", "low", "g")
    out = rows.join(ids, "set", "left")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    return out.select("row", F.col("n").alias("n_shingles"), "set", F.when(linked, F.col("low")).otherwise(F.col("id")).alias("component"), F.when(linked, F.col("g")).alias("linked"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join_groups(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_shingles", F.col("component").alias("component_id"))


_SETS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS sh FROM d)
"""
OP3_SQL = f"""
WITH RECURSIVE {_SETS.strip().removeprefix("WITH")},
t AS MATERIALIZED (SELECT r, doc_id, len(sh) AS n, hash(x) AS x FROM s, unnest(sh) AS u(x)),
f AS (SELECT x, count(*) AS df FROM t GROUP BY x),
o AS MATERIALIZED (SELECT r, n, x, row_number() OVER (PARTITION BY r ORDER BY df, x) AS k FROM t JOIN f USING (x) WHERE TRUE),
p AS (SELECT DISTINCT a.r AS a, b.r AS b FROM o a JOIN o b ON a.x = b.x AND a.r < b.r AND a.k <= a.n - (9 * a.n + 9) // 10 + 1 AND b.k <= b.n - (9 * b.n + 9) // 10 + 1 AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n),
i AS (SELECT p.a, p.b, any_value(x.n) + any_value(y.n) AS total, count(*) AS same FROM p JOIN t x ON x.r = p.a JOIN t y ON y.r = p.b AND y.x = x.x GROUP BY p.a, p.b),
e AS MATERIALIZED (SELECT a, b FROM i WHERE 100 * same >= 90 * (total - same)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT r, r AS z FROM s UNION SELECT c.r, g.b FROM c JOIN g ON g.a = c.z)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT c.r, min(z.doc_id) AS component_id FROM c JOIN s z ON z.r = c.z GROUP BY c.r) m USING (r)
"""
