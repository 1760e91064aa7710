"""Language identification with hyperdimensional profiles.

Every letter, and the space, has a random vector of +1 and -1 drawn from its
code point. An n-gram is bound as the product of its letters' vectors, each
rotated by its distance from the n-gram's end. The n-grams of a document are
bundled by addition, and so are those of all training documents of a language.
A document gets the language whose prototype is nearest by cosine.

Training adds one vector per language and task, so what is shuffled depends on
the number of tasks, languages and dimensions, not on the texts.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import carried, read, written

DIMENSIONS = 1024
N = 3
UNKNOWN = "und"
MAX_LANGUAGES = 8192  #: prototypes that are broadcast: 32 MB at most
ROWS = 256  #: documents bundled at a time
GRAMS = 4096  #: distinct n-grams whose vectors are made at a time


@cache
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its lower case where that is one code point."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    return letter, lower


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """Random +1/-1 vectors, a function of the code point alone."""
    seeds = points.astype(np.uint64)[:, None] * np.uint64(0x2545F4914F6CDD1D) + np.arange(dimensions // 64, dtype=np.uint64) + np.uint64(1)
    bits = np.unpackbits(W.mix(W.mix(seeds)).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def ngram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of packed n-grams (21 bits a letter)."""
    out = np.ones((len(grams), dimensions), dtype=np.float32)
    for k in range(N):
        points, at = np.unique((grams >> (21 * (N - 1 - k))) & 0x1FFFFF, return_inverse=True)
        out *= np.roll(letter_vectors(points, dimensions), N - 1 - k, axis=1)[at]
    return out


def ngram_counts(column: pa.Array):
    """Yields (first row, rows, whether a row has a letter, documents, packed
    distinct n-grams, n-gram index of each occurrence), some rows at a time."""
    letter, lower = _unicode()
    offsets, raw = W.buffers(column)
    for i, j in W.slices(offsets):
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            data = raw[offsets[a] : offsets[b]]
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets[a : b + 1] - offsets[a]]
            points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
            sizes = np.diff(at) + 2
            doc = np.repeat(np.arange(b - a), sizes)
            full = np.full(len(doc), 32, dtype=np.uint32)
            inner = np.ones(len(doc), dtype=bool)
            inner[np.cumsum(sizes) - 1] = inner[np.cumsum(sizes) - sizes] = False
            full[inner] = np.where(letter[points], lower[points], 32)
            space = full == 32
            keep = np.ones(len(doc), dtype=bool)
            keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
            full, doc = full[keep].astype(np.int64), doc[keep]
            has = np.bincount(doc[full != 32], minlength=b - a) > 0
            code = np.zeros(max(0, len(full) - N + 1), dtype=np.int64)
            for k in range(N):
                code |= full[k : k + len(code)] << (21 * (N - 1 - k))
            inside = doc[: len(code)] == doc[N - 1 :][: len(code)]
            index, grams = pd.factorize(code[inside])
            yield a, b - a, has, doc[: len(code)][inside], grams, index


def _bundles(owner: np.ndarray, owners: int, grams: np.ndarray, index: np.ndarray, dimensions: int) -> np.ndarray:
    """The bundle of each owner. Vectors of GRAMS n-grams at a time, so memory
    does not grow with a text."""
    out = np.zeros((owners, dimensions), dtype=np.float32)
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    for a in range(0, len(grams), GRAMS):
        n = min(GRAMS, len(grams) - a)
        lo, hi = np.searchsorted(index, [a, a + n])
        counts = np.bincount(owner[lo:hi] * n + index[lo:hi] - a, minlength=owners * n).reshape(owners, n)
        out += counts.astype(np.float32) @ ngram_vectors(grams[a : a + n], dimensions)
    return out


def train(labelled: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Prototypes (lang, dimension, value) from columns text and lang. Rows with
    a null text or lang teach nothing."""

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            codes, names = pd.factorize(batch.column(1).to_pandas())
            for a, rows, _, doc, grams, index in ngram_counts(batch.column(0)):
                own, local = np.unique(codes[a : a + rows], return_inverse=True)
                for k, v in zip(own, _bundles(local[doc], len(own), grams, index, dimensions), strict=True):
                    total[names[k]] = total.get(names[k], 0) + v.astype(np.int64)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "dimension", "value"])

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return rows.mapInArrow(bundle, "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value"))


def predict(docs: DataFrame, prototypes: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (the carried columns), lang_pred and score, the cosine, from 0 to 1.

    A null text, one without a letter, and every text if there are no
    prototypes, get `und` and 0. Equal cosines go to the smaller language name.
    """
    prototypes = written(prototypes)
    pairs = prototypes.toArrow().to_pandas() if prototypes.select("lang").distinct().count() <= MAX_LANGUAGES else None
    if pairs is None:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = pairs.pivot(index="lang", columns="dimension", values="value").fillna(0).sort_index()
    matrix = table.to_numpy(dtype=np.float32)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast((list(table.index), matrix))

    def score(batches):
        names, matrix = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, rows, has, doc, grams, index in ngram_counts(batch.column(1)):
                if not len(names):
                    langs += [UNKNOWN] * rows
                    scores.append(np.zeros(rows))
                    continue
                v = _bundles(doc, rows, grams, index, matrix.shape[1])
                near = (v @ matrix.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = near.argmax(axis=1)
                langs += [names[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                scores.append(np.where(has, np.clip(near[np.arange(rows), best], 0, 1), 0).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["row", "lang_pred", "score"])

    docs = carried(docs, text, keep)
    return docs.mapInArrow(score, T.StructType([docs.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def training_fold(doc_id: str = "doc_id"):
    """Documents that are not held out. A document without id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, train(docs.filter(training_fold())), keep=["doc_id"])
    return found.select("row.doc_id", (~training_fold("row.doc_id")).alias("held_out"), "lang_pred", "score")
