"""Benchmark decontamination by a prefix-filtered set containment join.

The sets on the benchmark side are the windows of its items: `window`
consecutive words, or the whole item where it has fewer. Their tokens are short
shingles. Tokens are ordered by rarity, counted over all documents. A document
contains a window only if it contains all of its tokens, so the necessary
prefix of a window is its one rarest token; only that is joined. A pair is
dropped at once if the window, aligned on the token, would begin before the
document or end after it. All others are verified word by word at that place.

The windows are dealt into blocks of bounded size, and one block at a time is
broadcast; a benchmark of any size takes more passes, not more memory. Nothing
is shuffled by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import carried, read, written

WINDOW = 13
TOKEN = 3  #: words in a token
BLOCK_WINDOWS = 200_000  #: windows broadcast at a time, about 50 MB

_SPAN = "array<struct<start:int,end:int>>"


def windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows with the ids of the items that hold them:
    (window_id, words array<long>, items array<string>).

    Items without words have no windows. An item without id still has windows;
    it just cannot be named. Items of the same id count once.
    """

    def cut(batches):
        for batch in batches:
            ids = batch.column(0)
            for part in W.split(batch.column(1), W.ALNUM):
                h = part.hashes().view(np.int64)
                rows, out = [], []
                for r in range(part.rows):
                    own = h[part.first[r] : part.first[r + 1]]
                    for k in range(max(1, len(own) - window + 1) if len(own) else 0):
                        rows.append(part.first_row + r)
                        out.append(own[k : k + window])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(out, pa.list_(pa.int64()))], names=["item", "words"])

    cuts = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, "item string, words array<bigint>")
    return cuts.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("window_id"), "words", "items")


def tokens(words: np.ndarray) -> np.ndarray:
    """The tokens of one window, from each position that has one."""
    n = min(TOKEN, len(words))
    return W.shingles(words, np.array([0, len(words)]), n)[: len(words) - n + 1]


class _Lookup:
    """Which of the given 64-bit keys occurs at which position."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[k] == hashes[at]
        return at[same], k[same]


def _frequencies(docs: DataFrame, block: list, lengths: list[int]) -> DataFrame:
    """In how many documents each token of the block's windows occurs, as
    (token long, df long). Tokens that occur nowhere have no row."""
    known = {n: _Lookup(np.concatenate([tokens(np.array(r, dtype=np.int64).view(np.uint64)) for r in block if min(TOKEN, len(r)) == n])) for n in lengths}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        known = shared.value
        total = {n: np.zeros(len(x.keys), dtype=np.int64) for n, x in known.items()}
        for batch in batches:
            for part in W.split(batch.column(0), W.ALNUM):
                h = part.hashes()
                doc = part.doc
                for n, x in known.items():
                    at, k = x.find(W.shingles(h, part.first, n))
                    at, k = at[ok := W.complete(part.first, n)[at]], k[ok]
                    pairs = np.unique(doc[at] * len(x.keys) + k) if len(at) else at
                    total[n] += np.bincount(pairs % max(1, len(x.keys)), minlength=len(x.keys))
        for n, x in known.items():
            some = np.flatnonzero(total[n])
            yield pa.RecordBatch.from_arrays([pa.array(x.keys[some].view(np.int64)), pa.array(total[n][some])], names=["token", "df"])

    return docs.select("text").mapInArrow(count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def _prefixes(spark: SparkSession, block: list, df: DataFrame) -> list:
    """The rarest token of each window, as (window, token, offset)."""
    rows = [(i, int(t), k) for i, r in enumerate(block) for k, t in enumerate(tokens(np.array(r, dtype=np.int64).view(np.uint64)).view(np.int64).tolist())]
    pairs = spark.createDataFrame(rows, "window int, token long, offset int").join(df, "token", "left").fillna(0, ["df"])
    first = Window.partitionBy("window").orderBy("df", "token", "offset")
    return pairs.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("window", "token", "offset").collect()


def _probe(docs: DataFrame, block: list, items: list, prefixes: list, lengths: list[int]) -> DataFrame:
    """docs (row, text, n_words, spans, items) with this block's hits added."""
    by_n = {}
    for n in lengths:
        own = [p for p in prefixes if min(TOKEN, len(block[p.window])) == n]
        keys = np.array([p.token for p in own], dtype=np.int64).view(np.uint64)
        order = np.argsort(keys, kind="stable")
        by_n[n] = (_Lookup(keys), keys[order], np.array([p.window for p in own])[order], np.array([p.offset for p in own])[order])
    width = np.array([len(r) for r in block])
    padded = np.zeros((len(block), max(width)), dtype=np.int64)
    for i, r in enumerate(block):
        padded[i, : len(r)] = r
    shared = docs.sparkSession.sparkContext.broadcast((by_n, width, padded.view(np.uint64), items))

    def hits(part: W.Words, h: np.ndarray):
        by_n, width, padded, _ = shared.value
        doc, none = part.doc, np.zeros(0, np.int64)
        yield none, none, none
        for n, (lookup, keys, window, offset) in by_n.items():
            at, k = lookup.find(W.shingles(h, part.first, n))
            lo, hi = np.searchsorted(keys, lookup.keys[k], "left"), np.searchsorted(keys, lookup.keys[k], "right")
            reps = hi - lo
            at = np.repeat(at, reps)
            j = np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            win, start = window[j], at - offset[j]
            fits = (start >= part.first[doc[at]]) & (start + width[win] <= part.first[doc[at] + 1])
            win, start, at = win[fits], start[fits], at[fits]
            good = np.ones(len(win), dtype=bool)
            for c in range(padded.shape[1]):
                inside = np.flatnonzero(good & (c < width[win]))
                good[inside] = h[start[inside] + c] == padded[win[inside], c]
            yield doc[at[good]], start[good], win[good]

    def probe(batches):
        width, names = shared.value[1], shared.value[3]
        for batch in batches:
            n_words, spans, found = [], [], []
            old_spans, old_items = batch.column(3), batch.column(4)
            for part in W.split(batch.column(1), W.ALNUM):
                h = part.hashes()
                got = [np.concatenate(x) for x in zip(*hits(part, h), strict=True)]
                cover = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(cover, got[1], 1)
                np.add.at(cover, got[1] + width[got[2]], -1)
                per_doc: dict[int, set] = {}
                for d, w in set(zip(got[0].tolist(), got[2].tolist(), strict=True)):
                    per_doc.setdefault(d, set()).update(names[w])
                touched = set(got[0].tolist())
                cover = np.cumsum(cover)[:-1] > 0
                n_words += part.counts.tolist()
                for r in range(part.rows):
                    before = old_spans[part.first_row + r].as_py()
                    mask = cover[part.first[r] : part.first[r + 1]]
                    if before:
                        mask = mask.copy()
                        for s in before:
                            mask[s["start"] : s["end"]] = True
                    if before or r in touched:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                        spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                    else:
                        spans.append([])
                    found.append(sorted(per_doc.get(r, set()).union(old_items[part.first_row + r].as_py())))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))], names=["row", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(probe, docs.schema)


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: row (the carried columns), n_words, spans (maximal
    runs of hit words, end exclusive) and items (ids of the items of which a
    window occurs).

    A null or wordless text has no words and no hits. Repeated documents each
    have a row. With an empty benchmark nothing is hit.
    """
    docs = carried(docs, text, keep).withColumns({"text": F.col("text").cast("string"), "n_words": F.lit(None).cast("long"), "spans": F.array().cast(_SPAN), "items": F.array().cast("array<string>")})
    spark = docs.sparkSession
    cut = written(windows(benchmark, window))
    blocks = max(1, -(-cut.count() // block_windows))
    for b in range(blocks):
        rows = cut.filter(F.pmod("window_id", F.lit(blocks)) == b).collect()
        block, items = [r["words"] for r in rows], [r["items"] for r in rows]
        lengths = sorted({min(TOKEN, len(r)) for r in block})
        prefixes = _prefixes(spark, block, _frequencies(docs, block, lengths)) if block else []
        if not block:
            block, items = [[0]], [[]]
        docs = _probe(docs, block, items, prefixes, lengths)
        if b < blocks - 1:
            docs = written(docs)
    return docs.drop("text")


def with_verdict(passages: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: at least a twentieth of the words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return passages.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_verdict(find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORD}'), []) AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
wins AS (SELECT DISTINCT n, win FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT r, i, n, win FROM dw SEMI JOIN wins USING (n, win)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit JOIN bw USING (n, win) WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
