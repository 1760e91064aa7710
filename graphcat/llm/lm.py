"""Language model scores from a subword lattice.

The vocabulary is an existing one; its pieces, and the order of their scores,
are taken as they are. A piece of score s, which stands for a rank, starts with
a weight of 1 / (rank + 2.7). All training documents then say how often each
piece is expected over all segmentations of their words, and those expected
counts, on top of the first weights as if seen PRIOR times in all, are the
model. A text's probability is the product, over its words and its end, of the
sums over all segmentations.

Words are counted over all training documents for the base score, by a round
trip of packed counts (see runs).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .lattice import MARK, Vocabulary, score
from .runs import Runs, cuts, unpacked
from .tables import read, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PRIOR = 1000.0
SMOOTH = 0.1
SUMMED = 64  #: runs whose expected counts are added up in one group
UNIT = 1 << 20  #: of an expected count


def load(path: str = VOCABULARY) -> Vocabulary:
    """Pieces of a SentencePiece file, on the driver. Control pieces, and those
    that its own scores rule out, are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank, byte, pieces = lambda i: 2.7 - model.get_score(i), np.full(256, -np.log(2.7 + model.get_piece_size())), []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and model.get_score(i) > -1e8:
            pieces.append((model.id_to_piece(i).encode(), -np.log(rank(i))))
    if MARK not in {p for p, _ in pieces}:
        pieces.append((MARK, -np.log(2.7 + model.get_piece_size())))
    made = Vocabulary(pieces, byte)
    made.weights = made.weights - np.log(np.exp(made.weights).sum())
    return made


def _run_words(texts, learns: np.ndarray | None):
    """Distinct word hashes of a run, sorted; for each, how often training texts
    have it and where one occurrence lies: (hashes, counts, bytes, start, end)."""
    found, counts, data, start, end, base = [], [], [], [], [], 0
    for part in W.split(texts, W.NOT_SPACE):
        h, at, inverse = np.unique(part.hashes(), return_index=True, return_inverse=True)
        weight = None if learns is None else learns[part.first_row : part.first_row + part.rows][part.doc].astype(np.float64)
        found.append(h)
        counts.append(np.bincount(inverse, weights=weight, minlength=len(h)).astype(np.int64))
        data.append(part.data)
        start.append(part.start[at] + base)
        end.append(part.end[at] + base)
        base += len(part.data)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, at, inverse = np.unique(np.concatenate(found), return_index=True, return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)
    return h, n, np.concatenate(data), np.concatenate(start)[at], np.concatenate(end)[at]


def _pieces(batches):
    """Rows (piece, n) of vectors of counts."""
    for batch in batches:
        for v in unpacked(batch.column(0), np.int64):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["piece", "n"])


class Model:
    """What the training documents say: the fitted vocabulary and, for each run,
    its words' counts over all training documents."""

    def __init__(self, runs: Runs, vocabulary: Vocabulary):
        spark = runs.documents.sparkSession
        n = runs.ranges
        shared = spark.sparkContext.broadcast(vocabulary)

        def tell(table: pa.Table) -> pa.Table:
            run = table.column("run")[0].as_py()
            learns = table.column("learns").to_numpy()
            h, counts, data, start, end = _run_words(table.column("text"), learns)
            use = np.flatnonzero(counts)
            _, expected = score(shared.value, data, start[use], end[use], counts[use].astype(np.float64))
            at = cuts(h, n)
            rows = [(r, run, h[at[r] : at[r + 1]].tobytes(), counts[at[r] : at[r + 1]].tobytes()) for r in np.flatnonzero(np.diff(at)).tolist()]
            # whole numbers, so that their sum does not depend on its order
            rows.append((-1 - run // SUMMED, run, b"", np.rint(np.append(expected, learns.sum()) * UNIT).astype(np.int64).tobytes()))
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "run", "keys", "counts"])

        told = runs.documents.select("run", "learns", "text").groupBy("run").applyInArrow(tell, "range int, run int, keys binary, counts binary")

        def combine(table: pa.Table) -> pa.Table:
            r = table.column("range")[0].as_py()
            if r < 0:
                total = np.sum(unpacked(table.column("counts"), np.int64), axis=0)
                return pa.table({"range": pa.array([r], pa.int32()), "run": pa.array([-1], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary()), "tokens": pa.array([0], pa.int64()), "distinct": pa.array([0], pa.int64())})
            keys, counts = unpacked(table.column("keys"), np.uint64), unpacked(table.column("counts"), np.int64)
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(total, inverse, np.concatenate(counts))
            parts = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
            m = len(parts)
            return pa.table({"range": pa.array([r] * m, pa.int32()), "run": table.column("run"), "counts": pa.array([p.tobytes() for p in parts], pa.binary()), "tokens": pa.array([int(total.sum())] + [0] * (m - 1), pa.int64()), "distinct": pa.array([int((total > 0).sum())] + [0] * (m - 1), pa.int64())})

        self.answers = written(told.groupBy("range").applyInArrow(combine, "range int, run int, counts binary, tokens long, distinct long"))
        sums = self.answers.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
        # sums of SUMMED runs each, added up piece by piece; one row a piece
        pieces = self.answers.filter("range < 0").select("counts").mapInArrow(_pieces, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros(len(vocabulary.weights) + 1)
        for r in pieces:
            expected[r["piece"]] = r["n"] / UNIT
        self.ends = round(expected[-1])
        self.tokens = (sums["tokens"] or 0) + self.ends
        self.distinct = (sums["distinct"] or 0) + (self.ends > 0)
        mass = expected[:-1] + PRIOR * np.exp(vocabulary.weights)
        self.vocabulary = vocabulary.reweighted(np.log(mass / mass.sum()))


def score_documents(docs: DataFrame, learns: Column, text: str = "text", id_column: str = "doc_id", keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """row (the carried columns), learns, n_tokens, n_known, train_tokens,
    base_score and score (log10 of the text's probability).

    learns says which rows train, null counts as false. A null or empty text is
    its end alone. Repeated rows each train and each have a row. With no
    training rows nothing is known and the first weights stay.
    """
    runs = Runs(docs, text, id_column, keep, learns=F.coalesce(learns, F.lit(False)))
    model = Model(runs, load(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
    tokens, distinct, ends = model.tokens, model.distinct, model.ends

    def apply(documents: pa.Table, answers: pa.Table) -> pa.Table:
        table = documents.combine_chunks()
        h, _, data, start, end = _run_words(table.column("text"), None)
        order = np.argsort(answers.column("range").to_numpy())
        parts = unpacked(answers.column("counts"), np.int64)
        counts = np.concatenate([parts[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        bottom = tokens + SMOOTH * (distinct + 1)
        base = np.log10((counts + SMOOTH) / bottom)
        weight = score(shared.value, data, start, end)[0] / np.log(10)
        last = np.log10((ends + SMOOTH) / bottom)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for part in W.split(table.column("text"), W.NOT_SPACE):
            at = np.searchsorted(h, part.hashes())
            add = lambda x: np.add.reduceat(np.append(x, 0.0), part.first[:-1]) * (part.counts > 0)  # noqa: B023, E731
            out["n_tokens"].append(part.counts + 1)
            out["n_known"].append(add((counts[at] > 0).astype(np.float64)).astype(np.int64) + (ends > 0))
            out["base_score"].append(add(base[at]) + last)
            out["score"].append(add(weight[at]) + last)
        joined = {k: np.concatenate(v) for k, v in out.items()}
        columns = [table.column("row"), table.column("learns"), pa.array(joined["n_tokens"], pa.int64()), pa.array(joined["n_known"], pa.int64()), pa.array(np.full(len(table), tokens), pa.int64()), pa.array(joined["base_score"]), pa.array(joined["score"])]
        return pa.Table.from_arrays(columns, names=["row", "learns", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([runs.documents.schema["row"], runs.documents.schema["learns"], *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def both(documents: pa.Table, answers: pa.Table) -> pa.Table:
        if len(documents):
            return apply(documents, answers)
        empty = pa.array([], pa.float64())
        return pa.Table.from_arrays([documents.column("row"), documents.column("learns"), *(empty.cast(pa.int64()) for _ in range(3)), empty, empty], names=["row", "learns", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    own = runs.documents.select("row", "text", "learns", "run").groupBy("run")
    return own.cogroup(model.answers.filter("range >= 0").select("range", "run", "counts").groupBy("run")).applyInArrow(both, schema)


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learns = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    docs = score_documents(read(spark, sf_dir, "documents"), learns.alias("learns"), keep=["doc_id"])
    return docs.select("row.doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
