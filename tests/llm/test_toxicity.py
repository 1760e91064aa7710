"""Toxicity: automata against plain edit distance, contexts, held-out accuracy
on planted texts, awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from graphcat.llm import toxicity
from graphcat.llm.levenshtein import Automaton, Term

BAD = ["grumblor", "zunderhog", "vexlik", "morphus"]


def distances(term, word):
    """Edit distance of a term to each beginning of a word."""
    row = list(range(len(word) + 1))
    for i, a in enumerate(term, 1):
        last, row = row, [i]
        for j, b in enumerate(word, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (a != b)))
    return row


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_automaton_against_edit_distance(seed):
    rng = random.Random(seed)
    spell = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [Term(spell(rng.randrange(2, 8)), rng.random() < 0.4, rng.randrange(3)) for _ in range(12)]
    automaton = Automaton(terms)
    for word in [spell(rng.randrange(0, 10)) for _ in range(500)]:
        near = []
        for n, t in enumerate(terms):
            d = distances(t.text, word)
            e = min(d[1:], default=9) if t.stem else d[-1]
            if t.stem:
                e = min(e, d[-1])
            if e <= t.edits and word:
                near.append((e, n))
        got = automaton.match(word)
        assert (got and (got[1], got[0])) == min(near, default=None)


def test_automaton_forgets_and_finds_again(monkeypatch):
    from graphcat.llm import levenshtein

    monkeypatch.setattr(levenshtein, "STEPS_KEPT", 3)
    monkeypatch.setattr(levenshtein, "WORDS_KEPT", 2)
    automaton = Automaton([Term("idiot", False, 1), Term("trash", True, 0)])
    words = {"idiot": (0, 0), "idiott": (0, 1), "odiot": (0, 1), "diot": (0, 1), "idot": (0, 1), "trashy": (1, 0), "tras": None, "house": None}
    for _ in range(3):
        assert {w: automaton.match(w) for w in words} == words
    assert Automaton([]).match("word") is None


def test_folded():
    assert [toxicity.folded(w) for w in ("1d10t", "$tup1d", "looooser", "2024", "plain", "aa")] == ["idiot", "stupid", "loser", "2024", "plain", "aa"]


def test_matches_have_places_and_contexts(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    automaton = Automaton([Term("idiot", False, 1)])
    text = 'You are an 1D10T! They quoted "idiot" once. İdiott stands alone, and an idot.'
    n, found = toxicity.matches(automaton, text)
    assert n == len(toxicity.WORD.findall(text))
    assert [(text[m.start : m.end], m.edits, m.quoted, m.aimed) for m in found] == [("1D10T", 0, False, True), ("idiot", 0, True, False), ("idot", 1, False, False)]
    alone = toxicity.matches(automaton, "far from all of it stands an idiot on a hill")[1]
    assert [(m.quoted, m.aimed) for m in alone] == [(False, False)]


def planted(rng, i, toxic):
    words = [f"w{rng.randrange(400)}x" for _ in range(rng.randrange(12, 60))]
    if toxic:
        for _ in range(3):
            words.insert(rng.randrange(len(words) + 1), rng.choice([*BAD[:3], f"{BAD[3]}{rng.choice(['ka', 'ti', 'ne', 'do'])}"]))
    return i, " ".join(words), int(toxic)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    rows = [planted(rng, i, i % 6 == 0) for i in range(900)]
    # a passage of a toxic text that many have is no evidence
    rows += [(1000 + i, "one passage that stands in all of these rows alike " + rows[0][1], 1) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, None, y) for i, _, y in rows] + [(0, 1, 0), (None, 1, 1), (5000, 0, 1), (3, 0, None)]
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_terms_learned(model):
    assert {t.text for t in model.terms} >= set(BAD[:3])
    assert any(t.stem and BAD[3].startswith(t.text) for t in model.terms)
    assert not any(t.text in "one passage that stands in all of these rows alike" for t in model.terms)


def test_held_out_misspelled_and_quoted(spark, model):
    rng = random.Random(9)
    rows = [planted(rng, i, i % 3 == 0) for i in range(150)]
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    clean = " ".join(f"w{k}x" for k in range(30))
    texts = [f"{clean} grumbl0r zunderhogg vexxlik {clean}", f'{clean} the word "grumblor" is quoted here {clean}', clean]
    bad, quoted, none = (r["score"] for r in toxicity.score(spark.createDataFrame(enumerate(texts), "doc_id long, text string").coalesce(1), model).collect())
    assert bad >= 0.5 > quoted > none


def test_awkward_rows(spark, docs, rows, nothing, model):
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if not (r["row"]["text"] or "").strip(" \n\t.")}
    assert len(empty) == 1
    assert toxicity.score(nothing, model).count() == 0
    long = " ".join(["w1x"] * 300_000) + " grumblor vexlik zunderhog"
    r = toxicity.score(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()
    assert [x["term"] for x in r["terms"]] == ["grumblor", "vexlik", "zunderhog"]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    plain = toxicity.train(docs, labels)
    assert plain.terms == [] and all(r["score"] < 0.5 for r in toxicity.score(docs, plain).collect())
    only = toxicity.train(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert only.terms == [] and all(r["score"] < 0.5 for r in toxicity.score(docs, only).collect())


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(3000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.sample(docs, labels, rows=50)
    assert {r["toxic"]: r["count"] for r in got.groupBy("toxic").count().collect()} == {0: 50, 1: 50}
