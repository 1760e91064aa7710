"""Removal of repeated byte strings by a distributed suffix merge sort.

Every window of 50 bytes has an anchor, the 20-byte string in it with the
smallest hash; equal windows have it at the same place. Only suffixes that
start at anchors are sorted, so a window is told by its anchor's suffix and the
few bytes on the left of it.

1. Runs of documents send the hashes of their anchors, with how often they
   have them; an anchor whose string only one document has is dropped.
2. Runs sort what stands around the anchors that are left, right side first,
   join equal ones, front-code them and send each range of anchors its part.
   A range merges its runs with a loser tree (see suffix_runs), which gives
   the prefixes that neighbours share, hence the strings with the same bytes
   from the anchor to a window's end. Among these it finds, for each offset of
   the window, the smallest document that has the same bytes before the anchor
   too, and answers one bit per offset and string of a run: whether that
   document lies before the run's first.
3. Runs mark the windows and cut the bytes out.

A string that many documents have is sent once by each run. An anchor that
occurs HOT times or more can have that many different surroundings, as at the
ends of a passage that all documents share. Its windows are sent as suffixes of
their own, each ranged by all of its bytes, so that no range gets more of one
anchor than HOT strings, or of one window than a string a run. A run sends a
row to a range only if it has keys there, so there are never more rows than
keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import suffix_runs
from . import words as W
from .runs import Runs, cuts, edges, parts_of, unpacked
from .tables import read, written

LENGTH = 50
ANCHOR = 20
LEFT = LENGTH - ANCHOR  #: the farthest that a window begins before its anchor
SPAN = 1 << 18  #: bytes of one text that are hashed together, in overlapping parts
PIECE = 1 << 16  #: bytes of several texts that are hashed together
RUN_BYTES = 8 << 20
HOT = 4096  #: occurrences of an anchor whose windows are sent one by one
WIDTH = LENGTH + LEFT + 2  #: of a string with its sizes
ONE_RUN = 127  #: a run's count of an anchor goes up to this

_SEVERAL = np.uint8(128)


def _part_anchors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the anchors of texts that lie at data[at[i]:at[i + 1]]."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    up, down = W.powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(W._BYTE[data] * up[:-1], out=total[1:])
    h = W.mix((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = np.uint64((1 << 23) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, LEFT + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    # a window must end before its text does
    inside = np.zeros(n + 1, dtype=np.int64)
    long = np.diff(at) >= LENGTH
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - LENGTH + 1, -1)
    return np.unique((least & low)[np.cumsum(inside)[: len(least)] > 0]).astype(np.int64)


def anchors(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Places in raw of the anchors of all texts of a column."""
    places = [np.zeros(0, np.int64)]
    for i, j in W.slices(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        for start in range(a, max(a + 1, b - LENGTH + 1), SPAN):
            end = min(b, start + SPAN + LENGTH - 1)
            # a long text stands alone in its slice
            at = offsets[i : j + 1] - a if start == a and end == b else np.array([0, end - start])
            places.append(_part_anchors(raw[start:end], at) + start)
    return np.unique(np.concatenate(places))


def _with_places(rows: DataFrame) -> DataFrame:
    """Adds places: the steps from a text's start to its first anchor, and from
    anchor to anchor, none longer than LEFT + 1, a byte each."""

    def look(batches):
        for batch in batches:
            offsets, raw = W.buffers(batch.column(batch.schema.get_field_index("text")))
            found = anchors(offsets, raw)
            first = np.searchsorted(found, offsets)
            steps = np.diff(found, prepend=0)
            some = np.flatnonzero(np.diff(first))
            steps[first[some]] = found[first[some]] - offsets[some]
            places = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(steps.astype(np.uint8))])
            yield pa.RecordBatch.from_arrays([*batch.columns, places], names=[*batch.schema.names, "places"])

    return rows.mapInArrow(look, T.StructType([*rows.schema.fields, T.StructField("places", T.BinaryType())]))


def _hashes(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the anchors at places, some bytes at a time."""
    out = np.empty(len(places), dtype=np.uint64)
    for start in range(0, len(raw), PIECE):
        i, j = np.searchsorted(places, [start, start + PIECE])
        data, at = raw[start : start + PIECE + ANCHOR], places[i:j] - start
        up, down = W.powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(W._BYTE[data] * up[:-1], out=total[1:])
        out[i:j] = W.mix((total[at + ANCHOR] - total[at]) * down[at])
    # anchors have small hashes, so these are spread again before they deal out ranges
    return W.mix(out + np.uint64(1))


class Run:
    """The anchors of a run's documents. Documents without id take no part."""

    def __init__(self, table: pa.Table):
        self.table = table = table.combine_chunks()
        self.offsets, self.raw = W.buffers(table.column("text"))
        ids = table.column("id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        steps = table.column("places").chunk(0) if table.column("places").num_chunks else pa.array([], pa.binary())
        first = np.frombuffer(steps.buffers()[1], dtype=np.int32)[steps.offset : steps.offset + len(steps) + 1] if len(steps) else np.zeros(1, np.int32)
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(steps.buffers()[2] or b"", dtype=np.uint8)[first[0] : first[-1]], dtype=np.int64)])
        first = first - first[0]
        counts = np.diff(first)
        places = np.repeat(self.offsets[:-1] - sums[first[:-1]], counts) + sums[1:]
        self._take(places, _hashes(self.raw, places))
        keep = self.known[self.doc]
        self._take(places[keep], self.hash[keep])

    def _take(self, places: np.ndarray, hashes: np.ndarray) -> None:
        self.place, self.hash = places, hashes
        self.doc = np.searchsorted(self.offsets, places, side="right") - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct hashes; for each how often it occurs, up to ONE_RUN,
        with _SEVERAL added if documents of several ids have it; and for each
        anchor its index among them."""
        h, inverse, counts = np.unique(self.hash, return_inverse=True, return_counts=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        return h, np.minimum(counts, ONE_RUN).astype(np.uint8) | np.where(low < high, _SEVERAL, np.uint8(0)), inverse

    def keep(self, shared: np.ndarray, hot: np.ndarray, inverse: np.ndarray) -> None:
        some = shared[inverse]
        self.hot = hot[inverse][some]
        self._take(self.place[some], self.hash[some])

    def strings(self, n: int):
        """What is sent to n ranges: (matrix, places at which the ranges are cut,
        low, ordinary, windows). Distinct and sorted in each range; low has the
        smallest ids.

        A row holds the bytes from a place on, then those before it from right
        to left, padded, and both sizes. ordinary is (anchors, their strings);
        windows has, for each offset, (hot anchors with that window, strings).
        """
        cold, hot = np.flatnonzero(~self.hot), np.flatnonzero(self.hot)
        right = np.minimum(self.offsets[self.doc + 1] - self.place, LENGTH)
        left = np.minimum(self.place - self.offsets[self.doc], LEFT)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.raw, np.zeros(LENGTH, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)
        parts = [_strings(around[self.place[cold]], right[cold], left[cold], self.hash[cold], self.ids[self.doc[cold]])]
        owners = [cold]
        for o in range(LEFT + 1 if len(hot) else 0):
            own = hot[(left[hot] >= o) & (right[hot] >= LENGTH - o)]
            whole, none = np.full(len(own), LENGTH), np.zeros(len(own), np.int64)
            parts.append(_strings(around[self.place[own] - o], whole, none, None, self.ids[self.doc[own]]))
            owners.append(own)
        joined, low, key = (np.concatenate([p[i] for p in parts]) for i in range(3))
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, same, low)
        rows = joined[first]
        # the range's number in place of the hash, then the string
        hashes = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
        rows[:, :8] = (np.searchsorted(edges(n), hashes, side="right") - 1).astype(">u8")[:, None].view(np.uint8)
        order = np.argsort(_opaque(rows), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        rows = rows[order]
        at = np.searchsorted(np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.int64), np.arange(n + 1))
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        of = [(own, place[same[ends[k] : ends[k + 1]]][p[3]]) for k, (own, p) in enumerate(zip(owners, parts, strict=True))]
        return rows[:, 8 : 8 + WIDTH], at, least[order], of[0], of[1:]


def _strings(around: np.ndarray, right: np.ndarray, left: np.ndarray, hashes: np.ndarray | None, ids: np.ndarray):
    """Distinct rows (hash, string, sizes, nothing), their smallest ids, what
    tells them apart, and which one each place has. Without hashes, that of all
    bytes of the string is taken."""
    wide = np.zeros((len(around), 8 + WIDTH + -WIDTH % 8), dtype=np.uint8)
    wide[:, 8 : 8 + LENGTH] = around[:, LEFT:]
    wide[:, 8 + LENGTH : 8 + LENGTH + LEFT] = around[:, LEFT - 1 :: -1] if LEFT else 0
    for size, start, full in ((right, 8, LENGTH), (left, 8 + LENGTH, LEFT)):
        short = np.flatnonzero(size < full)
        cut = np.where(np.arange(full) < size[short, None], wide[short, start : start + full], 0)
        wide[short, start : start + full] = cut
    wide[:, 8 + WIDTH - 2], wide[:, 8 + WIDTH - 1] = right, left
    if hashes is not None:
        wide[:, :8] = hashes.astype(">u8")[:, None].view(np.uint8)
    words = wide.view(np.uint64)
    key = np.zeros(len(wide), dtype=np.uint64)
    for k in range(words.shape[1]):
        key = W.mix(key + words[:, k])
    if hashes is None:
        wide[:, :8] = key.astype(">u8")[:, None].view(np.uint8)
    key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, inverse, ids)
    return wide[first], low, key, inverse


def _opaque(matrix: np.ndarray) -> np.ndarray:
    """Rows as single values, ordered byte by byte."""
    return np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1]))).ravel()


def _first_seen(strings: np.ndarray, shared: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For strings in merged order, with the length of the prefix that each
    shares with the one before, and smallest ids: a bit for each offset at which
    the window occurs with a smaller id."""
    right, left = strings[:, -2].astype(np.int64), strings[:, -1].astype(np.int64)
    bits = np.zeros(len(strings), dtype=np.uint32)
    up, _ = W.powers(LEFT + 1)
    before = np.zeros((len(strings), LEFT + 1), dtype=np.uint64)
    np.cumsum(W._BYTE[strings[:, LENGTH : LENGTH + LEFT]] * up[1 : LEFT + 1], axis=1, out=before[:, 1:])
    for o in range(LEFT + 1):
        # equal from the anchor to the window's end
        group = np.cumsum(shared < LENGTH - o)
        some = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        some = some[np.bincount(group[some], minlength=group[-1] + 1)[group[some]] > 1]
        if not len(some):
            continue
        key = group[some].astype(np.uint64)
        if o:
            key = W.mix(before[some, o] + W.mix(key))
            order = np.argsort(key, kind="stable")
            key, some = key[order], some[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        own = low[some]
        least = np.repeat(np.minimum.reduceat(own, start), np.diff(np.append(start, len(key))))
        bits[some[least < own]] |= np.uint32(1 << o)
    return bits


def _merged(blobs: list[tuple[bytes, bytes, np.ndarray]]) -> list[np.ndarray]:
    """Merges the runs of a range; for each run its answers in its own order."""
    out = [np.zeros(len(low), dtype=np.uint32) for _, _, low in blobs]
    at = [0] * len(blobs)
    strings, where, lengths = [], [], []

    def flush():
        # a run's strings leave the tree in the run's order
        runs = np.array(where)
        order = np.argsort(runs, kind="stable")
        counts = np.bincount(runs, minlength=len(blobs)).tolist()
        low = np.empty(len(runs), dtype=np.int64)
        low[order] = np.concatenate([blobs[r][2][at[r] : at[r] + n] for r, n in enumerate(counts)])
        bits = _first_seen(np.frombuffer(b"".join(strings), dtype=np.uint8).reshape(len(strings), -1), np.array(lengths), low)[order]
        done = 0
        for r, n in enumerate(counts):
            out[r][at[r] : at[r] + n] = bits[done : done + n]
            at[r] += n
            done += n
        strings.clear(), where.clear(), lengths.clear()

    for shared, r, string in suffix_runs.merge([b[:2] for b in blobs]):
        if shared < ANCHOR and len(strings) >= 1 << 16:  # groups are whole here
            flush()
        strings.append(string)
        where.append(r)
        lengths.append(shared)
    if strings:
        lengths[0] = 0
        flush()
    return out


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", keep: list[str] | None = None, hot_from: int = HOT) -> DataFrame:
    """row (the carried columns), n_bytes, removed (maximal runs of removed
    bytes, end exclusive) and kept (the bytes that stay).

    A byte goes if a 50-byte string over it also starts in a document with a
    smaller id. A null text is empty; texts of fewer bytes stay whole. Rows of
    one id do not count against each other. A row without id stays whole and
    counts against none.
    """
    runs = Runs(docs, text, id_column, keep, RUN_BYTES, _with_places)
    n = runs.ranges
    dealt = parts_of(docs.sparkSession, n)

    def tell(table: pa.Table) -> pa.Table:
        run = Run(table)
        h, seen, _ = run.distinct()
        at, own = cuts(h, n), table.column("run")[0].as_py()
        # 48 bits of a key: two strings taken for one are only compared in vain
        packed = np.ascontiguousarray(h.astype(">u8")[:, None].view(np.uint8)[:, :6])
        rows = [(int(r), own, packed[at[r] : at[r + 1]].tobytes(), seen[at[r] : at[r + 1]].tobytes()) for r in np.flatnonzero(np.diff(at))]
        return _table(rows, ("range", pa.int32()), ("run", pa.int32()), ("keys", pa.binary()), ("seen", pa.binary()))

    def combine(table: pa.Table) -> pa.Table:
        packed = [k.reshape(-1, 6) for k in unpacked(table.column("keys"), np.uint8)]
        sizes = [len(k) for k in packed]
        keys = np.zeros((sum(sizes), 8), dtype=np.uint8)
        keys[:, 2:] = np.concatenate(packed)
        seen = np.concatenate(unpacked(table.column("seen"), np.uint8))
        _, inverse, runs = np.unique(keys.view(">u8").ravel().astype(np.uint64), return_inverse=True, return_counts=True)
        shared = runs > 1
        shared[inverse[seen >= _SEVERAL]] = True
        hot = np.bincount(inverse, weights=seen & ~_SEVERAL) >= hot_from
        parts = np.cumsum(sizes)[:-1]
        bits = lambda x: pa.array([np.packbits(p).tobytes() for p in np.split(x[inverse], parts)], pa.binary())
        return pa.table({"range": table.column("range"), "run": table.column("run"), "shared": bits(shared), "hot": bits(hot & shared), "n": pa.array(sizes, pa.int32())})

    own = runs.documents.select("run", "id", "text", "places")
    told = own.groupBy("run").applyInArrow(tell, "range int, run int, keys binary, seen binary")
    shared = written(told.repartition(dealt, "range").groupBy("range").applyInArrow(combine, "range int, run int, shared binary, hot binary, n int"))

    def narrowed(table: pa.Table, answers: pa.Table) -> Run:
        run = Run(table)
        _, _, inverse = run.distinct()
        order = np.argsort(answers.column("range").to_numpy())
        sizes = answers.column("n").to_pylist()

        def bits(name: str) -> np.ndarray:
            parts = [np.unpackbits(s, count=k) for s, k in zip(unpacked(answers.column(name), np.uint8), sizes, strict=True)]
            return np.concatenate([parts[i] for i in order]).astype(bool) if parts else np.zeros(0, bool)

        run.keep(bits("shared"), bits("hot"), inverse)
        return run

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = (("range", pa.int32()), ("run", pa.int32()), ("heads", pa.binary()), ("rests", pa.binary()), ("low", pa.binary()))
        if not len(table):
            return _table([], *kinds)
        wide, at, low, _, _ = narrowed(table, answers).strings(n)
        rows = []
        for r in np.flatnonzero(np.diff(at)):
            part = wide[at[r] : at[r + 1]]
            heads, rests = suffix_runs.encode(part, np.full(len(part), part.shape[1]))
            rows.append((int(r), table.column("run")[0].as_py(), heads, rests, low[at[r] : at[r + 1]].tobytes()))
        return _table(rows, *kinds)

    def settle(table: pa.Table) -> pa.Table:
        bits = _merged(list(zip(table.column("heads").to_pylist(), table.column("rests").to_pylist(), unpacked(table.column("low"), np.int64), strict=True)))
        return pa.table({"range": table.column("range"), "run": table.column("run"), "bits": pa.array([b.tobytes() for b in bits], pa.binary())})

    by_run = shared.groupBy("run")
    sent = own.groupBy("run").cogroup(by_run).applyInArrow(send, "range int, run int, heads binary, rests binary, low binary")
    settled = written(sent.repartition(dealt, "range").groupBy("range").applyInArrow(settle, "range int, run int, bits binary"))
    answers = shared.withColumn("bits", F.lit(None).cast("binary")).unionByName(settled, allowMissingColumns=True)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        is_first = answers.column("bits").is_null()
        if not len(table):
            return _table([], ("row", table.schema.field("row").type), *_OUT)
        run = narrowed(table, answers.filter(is_first))
        _, at, low, ordinary, windows = run.strings(n)
        bits = np.zeros(len(low), dtype=np.uint32)
        second = answers.filter(answers.column("bits").is_valid())
        for r, b in zip(second.column("range").to_pylist(), unpacked(second.column("bits"), np.uint32), strict=True):
            bits[at[r] : at[r + 1]] = b
        ids = run.ids[run.doc]
        starts = []

        def mark(anchors: np.ndarray, o: int) -> None:
            start, doc = run.place[anchors] - o, run.doc[anchors]
            starts.append(start[(start >= run.offsets[doc]) & (start + LENGTH <= run.offsets[doc + 1])])

        anchors, string = ordinary
        own = np.where(ids[anchors] > low[string], np.uint32((1 << (LEFT + 1)) - 1), bits[string])
        for o in range(LEFT + 1):
            mark(anchors[(own >> np.uint32(o)) & np.uint32(1) > 0], o)
            hot, string = windows[o] if windows else (anchors[:0], string[:0])
            mark(hot[(ids[hot] > low[string]) | (bits[string] & np.uint32(1) > 0)], o)
        opens = np.zeros(len(run.raw) + 1, dtype=np.int8)
        opens[np.concatenate(starts)] = 1
        # a byte goes if a window starts at it or at one of the bytes before it
        last = np.maximum.accumulate(np.where(opens[:-1], np.arange(len(run.raw), dtype=np.int32), np.int32(-LENGTH)))
        gone = np.arange(len(run.raw)) - last < LENGTH
        removed, kept = [], []
        for a, b in zip(run.offsets[:-1], run.offsets[1:], strict=True):
            mask = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            removed.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
            kept.append(run.raw[a:b][~mask].tobytes())
        return pa.Table.from_arrays([run.table.column("row"), pa.array(np.diff(run.offsets)), pa.array(removed, _OUT[1][1]), pa.array(kept, pa.binary())], names=["row", "n_bytes", "removed", "kept"])

    schema = T.StructType([runs.documents.schema["row"], *T._parse_datatype_string("n_bytes long, removed array<struct<start:int,end:int>>, kept binary").fields])
    return runs.documents.select("row", "text", "id", "places", "run").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(cut, schema)


_OUT = (("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary()))


def _table(rows: list[tuple], *kinds: tuple[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"), keep=["doc_id"])
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("row.doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# texts in overlapping chunks first, as places in long strings are slow to find
_CHUNK = 512
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
k AS (SELECT r, doc_id, c, substr(h, 2 * c + 1, {2 * (_CHUNK + LENGTH - 1)}) AS h FROM d, unnest(range(0, length(h) // 2, {_CHUNK})) AS t(c)),
p AS (SELECT r, doc_id, c + i AS i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * (i + {LENGTH}) <= length(h) THEN substr(h, 2 * i + 1, {2 * LENGTH}) END AS w FROM k, unnest(range(0, least({_CHUNK}, length(h) // 2))) AS t(i)),
f AS (SELECT w, min(doc_id) AS low FROM p WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)),
c AS (SELECT p.r, i, b, coalesce(max(CASE WHEN low < doc_id THEN i END) OVER (PARTITION BY p.r ORDER BY i ROWS UNBOUNDED PRECEDING) > i - {LENGTH}, FALSE) AS gone FROM p LEFT JOIN f ON p.w = f.w),
e AS (SELECT r, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS opens FROM c),
s AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""
