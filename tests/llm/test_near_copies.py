"""Near copies by five words and 80 percent, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphcat.llm import jaccard

from . import brute


def components(docs, n, percent):
    sets = [(i, brute.shingles(t, n)) for i, t in docs]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and group[a] != group[b] and 100 * len(x & y) >= percent * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(sets, group, strict=True):
        low[g] = min(low.get(g, i), i)
    return [(i, len(s), low[g]) for (i, s), g in zip(sets, group, strict=True)]


def near_texts():
    """Texts of sizes around those at which keys change, each with copies that
    have text appended or cut in, or words changed."""
    rng = random.Random(8)
    texts = []
    for size in (1, 4, 5, 12, 40, 127, 130, 132, 135, 148, 150, 163, 164, 165, 170, 180, 201, 206, 320):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        new = lambda k: [f"n{rng.randrange(3000)}" for _ in range(k)]
        cut = rng.randrange(size)
        texts += [base, base + new(size // 7), base + new(size // 5 + 1), base[:cut] + new(size // 6) + base[cut:], base[: size * 5 // 6]]
        texts.append([w if (i + 1) % 50 else "x" for i, w in enumerate(base)])
    return [(3 * i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("frequent,large", [(64, 256), (-(10**6), 256), (-(10**6), 2)])
def test_near_copies_by_five_words(spark, monkeypatch, frequent, large):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LARGE", large)
    texts = near_texts()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = jaccard.join_groups(df, n=5, percent=80).collect()
    assert sorted((r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in got) == sorted(components(texts, 5, 80))


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_keys_of_small_groups(percent):
    """As few shingles as can be in a group: one of each pair, two of each triple."""
    lone = [(g << 7) | 1 for g in range(64)]
    twos = [(g << 7) | c for g in range(32) for c in (2, 3)]
    rest = [(1 << 40) + i for i in range(400)]
    kind = dict.fromkeys(lone, 50) | dict.fromkeys(twos, 500)
    for n in (*range(100, 270), 400):
        a = np.array(sorted((lone + twos + rest)[:n]), dtype=np.uint64)
        least = -(-percent * n // 100)
        b = np.array(sorted((lone + twos + rest)[:least]), dtype=np.uint64)
        estimate = lambda s: np.array([kind.get(int(x), 1) for x in s])
        (x, k), (y, m) = (jaccard.keys_of(s, estimate(s), 10, 100, percent) for s in (a, b))
        assert len(np.intersect1d(x, y)) >= max(1, min(k, m)), n


def test_stage_drops_copies_with_text_appended(spark, tmp_path):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = [base, base + [f"n{i}" for i in range(30)], [w if (i + 1) % 50 else "x" for i, w in enumerate(base)], [f"o{i}" for i in range(200)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_stage_tells_texts_of_one_id_apart(spark, tmp_path):
    """A near copy goes although another text of its id stays; texts of one id in
    one group leave one, wordless texts and those without an id stay."""
    rng = random.Random(4)
    base, other = ([f"{c}{rng.randrange(900)}" for _ in range(120)] for c in "wo")
    join = " ".join
    rows = [(1, join(base)), (5, join([*base, "more"])), (5, join(other)), (5, join(other)), (7, join(["pre", *other])), (9, None), (9, "a b c d e f"), (9, "  "), (None, join(base))]
    rows += [(11, join(f"z{k}" for k in range(100))), (11, join(f"z{k}" for k in range(101)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_digest0", F.lit("clash"))
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()]
    z = [t for i, t in got if i == 11]
    assert len(z) == 1 and z[0] in {t for i, t in rows if i == 11}
    key = lambda x: (x[0] or 0, x[1] or "")
    assert sorted((x for x in got if x[0] != 11), key=key) == sorted([rows[0], rows[2], (9, None), (9, "a b c d e f"), (9, "  "), rows[8]], key=key)


def test_more_runs_than_buckets(spark, monkeypatch):
    """Runs and parts beyond the number of buckets that Spark allows share them."""
    from graphcat.llm import lm, suffix_dedup

    texts = near_texts()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    learns = F.col("doc_id") % 2 == 0

    def results():
        kept = suffix_dedup.remove_repeats(df, keep=["doc_id"]).select("row.doc_id", F.sha2("kept", 256))
        scores = lm.score_documents(df, learns, keep=["doc_id"]).select("row.doc_id", "base_score", "score")
        return sorted(map(tuple, kept.collect())), sorted(map(tuple, scores.collect()))

    want = results()
    monkeypatch.setattr(jaccard, "PART", 4)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 2000)
    monkeypatch.setattr(lm.Runs.__init__, "__defaults__", (2000, None))
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "8")
    try:
        got = jaccard.join_groups(df, n=5, percent=80).collect()
        assert sorted((r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in got) == sorted(components(texts, 5, 80))
        (kept, scores), (kept_before, scores_before) = results(), want
        assert kept == kept_before
        # expected counts are rounded once a run
        assert np.array(scores) == pytest.approx(np.array(scores_before), rel=1e-4)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
