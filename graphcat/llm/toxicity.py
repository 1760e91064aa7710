"""Toxicity by a lexicon of terms, their misspellings and the words around them.

The lexicon is learned: words and beginnings of words that stand in texts marked
toxic far more often than in others. An occurrence counts once for each pair of
neighbours that it has, so copies of a passage are no evidence. Levenshtein
automata of all terms, intersected with their trie, find them in texts, also
misspelled. A window around each match tells whether it is quoted or spoken of
(quotation marks, words of reporting) or aimed at someone (second person,
exclamation). Weights of quoted, misspelled and plain matches are fitted by
logistic regression, each text without its own share in the terms' weights. How much a
term's misspellings tell is counted apart, as words that only look like it may be
innocent; a term of which none was seen has a share of its own weight.

Terms and weights come from a bounded sample of labelled rows, SAMPLE of each
class at most (all, if fewer); every text is scored as a whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .levenshtein import Automaton, Term
from .tables import carried, read, written

SAMPLE = 10_000  #: labelled rows of each class that terms and weights are learned from
TERMS = 4096  #: terms of the lexicon at most
STEM_LETTERS = (3, 8)  #: letters of a term that is a beginning of words
WORD_LETTERS = (3, 40)
NEAR_SHARE, NEAR_PRIOR = 0.6, 2.0  #: weight of a term's misspellings before any is seen, and in how many words it counts
LEAST_RATIO = 4.0  #: times that a term must be more frequent in toxic texts
CHUNK = 1 << 18  #: characters that are split into words at a time
WINDOW = 80  #: characters on each side of a match, within its sentence, that tell its context

WORD = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*")
_GAP = re.compile(r"[\W_]")
_LONG_RUN = re.compile(r"(.)\1{2,}")
#: Characters written in place of letters.
LOOKALIKES = str.maketrans("0134578@$!", "oieastbasi")
#: Quotation marks, words of reporting, words of the second person.
QUOTES = re.compile(r"[\"“”„«»‹›`‘]")
SENTENCE_END = re.compile(r"[.?!\n]+[\"”»’]?")
REPORTING = frozenset("said says wrote quote quoted quoting called word words term slur phrase insult sagte schrieb zitat zitierte wort dit écrit citation mot dijo escribió cita palabra".split())
ADDRESSED = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton vous votre tú usted ti vos".split())

#: What a feature's weight is taken to be before any text is seen.
FEATURES = {"always": -4.0, "plain": 2.0, "quoted": 0.5, "misspelled": 1.5, "misspelled_quoted": 0.3, "aimed": 0.3, "share": 0.3, "words": 0.0}


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    counts: list[tuple[int, int]] = field(default_factory=list)  #: neighbour pairs in toxic and other texts
    near: dict[int, tuple[int, int]] = field(default_factory=dict)  #: the same of words within a term's edits
    totals: tuple[int, int] = (0, 0)
    weights: list[float] = field(default_factory=lambda: list(FEATURES.values()))


@dataclass
class Match:
    start: int
    end: int
    term: int
    edits: int
    quoted: bool
    aimed: bool


def folded(word: str) -> str:
    """A word with letters in place of their lookalikes and no letter thrice in a row."""
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(LOOKALIKES)
    return _LONG_RUN.sub(r"\1", word) if len(word) > 3 and _LONG_RUN.search(word) else word


def _chunks(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text with their places, cut between words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        yield at, text[at:end]
        at = end


def _context(low: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a match is quoted or spoken of, and whether it is aimed at someone."""
    left, right = SENTENCE_END.split(low[max(0, start - WINDOW) : start])[-1], low[end : end + WINDOW]
    if stop := SENTENCE_END.search(right):
        right = right[: stop.end()]
    near = WORD.findall(left)[-6:] + WORD.findall(right)[:6]
    quoted = bool(QUOTES.search(left) and len(QUOTES.findall(left)) % 2 and QUOTES.search(right)) or not REPORTING.isdisjoint(near)
    return quoted, not ADDRESSED.isdisjoint(near) or "!" in right[-2:]


def matches(automaton: Automaton, text: str) -> tuple[int, list[Match]]:
    """How many words a text has, and all matches of terms."""
    low, count, found = text.lower(), 0, []
    if len(low) != len(text):  # a letter that gets longer: places are those of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    match = automaton.match
    for at, part in _chunks(low):
        words = WORD.findall(part)
        count += len(words)
        hits = {w: m for w in set(words) if len(w) <= WORD_LETTERS[1] and (m := match(folded(w)))}
        if hits:
            for m in WORD.finditer(part):
                if hit := hits.get(m[0]):
                    start, end = at + m.start(), at + m.end()
                    found.append(Match(start, end, *hit, *_context(low, start, end)))
    return count, found


def log_ratio(model: Model, a: int, b: int) -> float:
    """How much more frequent something is in toxic than in other texts."""
    return math.log((max(a, 0) + 0.5) / (max(b, 0) + 0.5)) - math.log((model.totals[0] + 1) / (model.totals[1] + 1))


def term_weight(model: Model, term: int, edits: int, toxic: int | None = None) -> float:
    """Log ratio of a term's frequency in toxic and in other texts; without one
    text of which the label is given. For misspellings, that of what looks like it,
    drawn towards NEAR_SHARE of the term's."""
    a, b = model.counts[term]
    if not edits:
        return max(0.0, log_ratio(model, a - (toxic == 1), b - (toxic == 0)))
    near_a, near_b = model.near.get(term, (0, 0))
    near_a, near_b = max(0, near_a - (toxic == 1)), max(0, near_b - (toxic == 0))
    n = near_a + near_b
    return max(0.0, (n * log_ratio(model, near_a, near_b) + NEAR_PRIOR * NEAR_SHARE * log_ratio(model, a, b)) / (n + NEAR_PRIOR))


def features(model: Model, words: int, found: list[Match], toxic: int | None = None) -> list[float]:
    """One value for each of FEATURES. Each term counts by its best match."""
    best: dict[int, Match] = {}
    for m in found:
        old = best.get(m.term)
        if old is None or (m.quoted, m.edits) < (old.quoted, old.edits):
            best[m.term] = m
    sums = {"plain": 0.0, "quoted": 0.0, "misspelled": 0.0, "misspelled_quoted": 0.0}
    weight = {t: term_weight(model, t, m.edits, toxic) for t, m in best.items()}
    for t, m in best.items():
        sums[{(0, 0): "plain", (0, 1): "quoted", (1, 0): "misspelled", (1, 1): "misspelled_quoted"}[min(m.edits, 1), int(m.quoted)]] += weight[t]
    share = sum(weight[m.term] for m in found if m.edits == best[m.term].edits and not m.quoted) / max(words, 1)
    return [1.0, *(math.log1p(v) for v in sums.values()), math.log1p(sum(m.aimed for m in found)), math.log1p(100 * share), math.log1p(words) / 10]


def probability(weights: list[float], values: list[float]) -> float:
    z = sum(w * x for w, x in zip(weights, values, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton's method, pulled towards FEATURES."""
    prior = np.array(list(FEATURES.values()))
    w = prior.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * ((w - prior) ** 2).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return [float(v) for v in w]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, around, toxic): each text's distinct words, with the words beside the first one."""
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            low = (text.as_py() or "").lower()
            first: dict[str, int] = {}
            last = ""
            for _, part in _chunks(low):
                words = [folded(w) for w in WORD.findall(part)]
                for i, w in enumerate(words):
                    if w not in first and WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1]:
                        first[w] = zlib.crc32(f"{words[i - 1] if i else last} {words[i + 1] if i + 1 < len(words) else ''}".encode())
                last = words[-1] if words else last
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(list(first.values()), pa.int64()), pa.array([toxic] * len(first), pa.int32())], names=["word", "around", "toxic"])


def _surprise(a: Column, b: Column, total_a: int, total_b: int) -> Column:
    """Likelihood ratio of a and b against the shares that all words have."""
    n, share = a + b, total_a / max(total_a + total_b, 1)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return 2 * (part(a, share) + part(b, 1 - share))


def edits_of(text: str, stem: bool) -> int:
    """How many letters of a term may be wrong."""
    return sum(len(text) >= least for least in ((6,) if stem else (5, 9)))


def distinct_terms(ranked: list[tuple[str, bool, int, int]]) -> list[tuple[str, bool, int, int]]:
    """Of terms that begin with each other, the first in rank."""
    kept, stems, begun = [], set(), set()
    for text, stem, a, b in ranked:
        begins = {text[:k] for k in range(1, len(text) + 1)}
        if stems & begins or (stem and text in begun):
            continue
        kept.append((text, stem, a, b))
        begun |= begins
        if stem:
            stems.add(text)
    return kept


def lexicon(labelled: DataFrame) -> Model:
    """Terms of labelled texts (text, toxic 0 or 1)."""
    seen = labelled.mapInArrow(_neighbours, "word string, around long, toxic int").distinct()
    toxic = F.sum("toxic").cast("long").alias("a"), F.sum(1 - F.col("toxic")).cast("long").alias("b")
    words = written(seen.groupBy("word").agg(*toxic))
    total = words.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    if not total[0] or not total[1]:
        return Model()
    lengths = F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.length("word") - 1, F.lit(STEM_LETTERS[1])))
    stems = words.filter(F.length("word") > STEM_LETTERS[0]).select(F.explode(F.transform(lengths, lambda k: F.substring("word", F.lit(1), k))).alias("word"), "a", "b")
    stems = stems.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).filter("n > 1").select("word", F.lit(True).alias("stem"), "a", "b")
    both = words.select("word", F.lit(False).alias("stem"), "a", "b").unionByName(stems).filter("a > 1")
    # as surprising as the most surprising of so many random terms
    log_n = 2 * math.log(max(total[2], 3))
    best = both.withColumn("surprise", _surprise(F.col("a"), F.col("b"), total[0], total[1])).filter((F.col("surprise") > log_n - math.log(log_n)) & (F.col("a") * total[1] > F.col("b") * (LEAST_RATIO * total[0])))
    ranked = best.orderBy(F.desc("surprise"), "stem", F.desc(F.length("word")), "word").limit(TERMS).select("word", "stem", "a", "b").collect()
    kept = distinct_terms([tuple(r) for r in ranked])
    model = Model([Term(t, s, edits_of(t, s)) for t, s, _, _ in kept], [(a, b) for _, _, a, b in kept], totals=(total[0], total[1]))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms)
        for batch in batches:
            rows = [(m[0], a, b) for w, a, b in zip(*(batch.column(c).to_pylist() for c in ("word", "a", "b")), strict=True) if (m := automaton.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["term", "a", "b"])

    near = words.mapInArrow(alike, "term long, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    model.near = {r["term"]: (r["a"], r["b"]) for r in near.collect()}
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """(text, toxic): at most so many labelled texts of each class, chosen by a
    hash of their ids; equal texts with one label once. labels is (doc_id, toxic);
    a document with several labels is toxic if one says so."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known.withColumn("draw", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 31))))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for toxic, n in sorted(sizes.items()):
        part = known.filter(F.col("toxic") == toxic)
        if n > rows:  # few more than rows come to the sort
            part = part.filter(F.col("draw") < int((1 << 31) * min(1.0, (rows + 6 * math.sqrt(rows)) / n)))
        chosen.append(part.orderBy("draw", "doc_id").limit(rows))
    if not chosen:
        return docs.select("text", F.lit(0).alias("toxic")).limit(0)
    picked = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    texts = docs.filter("text IS NOT NULL").join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").select("text", "toxic", F.xxhash64("text").alias("same"))
    return written(texts.dropDuplicates(["same", "toxic"]).select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE) -> Model:
    """A model of labelled documents. Without labels of both classes, or without a
    telling term, it is that of FEATURES alone."""
    labelled = sample(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), labels.select(F.col("doc_id"), F.col("toxic")), rows)
    model = lexicon(labelled)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms)
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            values = [features(model, *matches(automaton, t.as_py() or ""), y) for t, y in zip(batch.column("text"), toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["toxic", "x"])

    # sums of equal rows: no more rows than the sample has
    seen = labelled.mapInArrow(each, "toxic int, x array<double>").collect()
    if seen:
        order = sorted((tuple(r["x"]), r["toxic"]) for r in seen)
        model.weights = fit_weights(np.array([x for x, _ in order]), np.array([y for _, y in order], dtype=float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (the carried columns), score (0 to 1) and terms: the matches of a text
    as structs of start and end (code points), term, edits, quoted and aimed.

    A null text counts as empty, and both have the score of a text without
    words. Each row has a row, repeated ones too; any column but text may be
    null or have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms)
        names = ["start", "end", "term", "edits", "quoted", "aimed"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("aimed", pa.bool_())]))
        for batch in batches:
            scores, terms = [], []
            for t in batch.column("text"):
                words, found = matches(automaton, t.as_py() or "")
                scores.append(probability(model.weights, features(model, words, found)))
                terms.append([dict(zip(names, (m.start, m.end, model.terms[m.term].text, m.edits, m.quoted, m.aimed), strict=True)) for m in found])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), pa.array(terms, kind)], names=["row", "score", "terms"])

    rows = carried(docs, text, keep)
    found = "array<struct<start:bigint,end:bigint,term:string,edits:int,quoted:boolean,aimed:boolean>>"
    schema = rows.select("row", F.lit(0.0).alias("score"), F.lit(None).cast(found).alias("terms")).schema
    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out()))
    found = score(docs, model, keep=["doc_id"]).withColumn("doc_id", F.col("row.doc_id"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
