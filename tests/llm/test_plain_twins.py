"""Language profiles, flows and mixes against plain Python."""

import random
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphcat.llm import langid, mixing, reshard


def _plain_bundle(text):
    """The sum of bound n-grams, letter by letter."""
    letters = [c.lower() if len(c.lower()) == 1 else c for c in text]
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in letters).split()) + " "
    out = np.zeros(langid.DIMENSIONS)
    for i in range(len(clean) - langid.N + 1):
        bound = np.ones(langid.DIMENSIONS)
        for k, c in enumerate(clean[i : i + langid.N]):
            bound *= np.roll(langid.letter_vectors(np.array([ord(c)]), langid.DIMENSIONS)[0], langid.N - 1 - k)
        out += bound
    return out


def test_profiles_are_those_of_plain_bundling(spark):
    draw = random.Random(5)
    words = {"aa": ["the", "Thing", "with", "of"], "bb": ["los", "niño", "QUE", "para"], "cc": ["straße", "über", "nicht", "日本語"]}
    text = lambda lang: draw.choice(["", " ", "1. "]) + draw.choice([" ", ", ", "  2 "]).join(draw.choice(words[lang]) for _ in range(draw.randrange(1, 30)))
    made = [(k, text(lang), lang) for k, lang in enumerate(list(words) * 6)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    trained = langid.train(docs.filter("doc_id < 9"))
    want = {lang: sum(_plain_bundle(t) for k, t, of in made if of == lang and k < 9) for lang in words}
    got = {lang: np.zeros(langid.DIMENSIONS) for lang in words}
    for r in trained.collect():
        got[r["lang"]][r["dimension"]] = r["value"]
    assert all(np.array_equal(got[lang], want[lang]) for lang in words)
    unit = {lang: v / np.linalg.norm(v) for lang, v in want.items()}
    for r in langid.predict(docs, trained).select("row.doc_id", "row.text", "lang_pred", "score").collect():
        v = _plain_bundle(r["text"])
        near = {lang: float(v @ u / np.linalg.norm(v)) for lang, u in unit.items()}
        assert r["lang_pred"] == max(near, key=near.get)
        assert r["score"] == pytest.approx(max(0.0, near[r["lang_pred"]]), abs=1e-5)


def _least_cost(supply, capacity, cost):
    """All ways to send one unit after the other."""

    @cache
    def rest(units, room):
        if not units:
            return 0
        i = units[0]
        return min(cost(i, j) + rest(units[1:], room[:j] + (n - 1,) + room[j + 1 :]) for j, n in enumerate(room) if n)

    return rest(tuple(i for i, n in enumerate(supply) for _ in range(n)), tuple(capacity))


def test_flows_cost_least():
    draw = random.Random(11)
    for _ in range(60):
        a, b = draw.randrange(1, 5), draw.randrange(1, 5)
        supply = [draw.randrange(4) for _ in range(a)]
        capacity = [0] * b
        for _ in range(sum(supply)):
            capacity[draw.randrange(b)] += 1
        prices = [[draw.randrange(5) for _ in range(b)] for _ in range(a)]
        flow = reshard.min_cost_flow(supply, capacity, lambda i, j, p=prices: p[i][j])
        assert [sum(n for (x, _), n in flow.items() if x == i) for i in range(a)] == supply
        assert [sum(n for (_, y), n in flow.items() if y == j) for j in range(b)] == capacity
        assert sum(n * prices[i][j] for (i, j), n in flow.items()) == _least_cost(supply, capacity, lambda i, j, p=prices: p[i][j])


def test_transfers_move_about_the_fewest_bytes():
    draw = random.Random(2)
    for _ in range(20):
        shards = draw.randrange(2, 7)
        blocks = [(o, k, draw.randrange(1, 50)) for o in range(draw.randrange(1, 9)) for k in range(draw.randrange(1, 60))]
        new = reshard.transfers(blocks, shards)
        assert set(new) == {(o, k) for o, k, _ in blocks}
        filled, old, total = Counter(), Counter(), sum(n for *_, n in blocks)
        for o, k, n in blocks:
            filled[new[o, k]] += n
            old[o] += n
        assert all(abs(filled[j] - total / shards) <= 50 for j in range(shards))
        # what a shard holds beyond its share must go; a block at most is rounded for each pair
        least = total - sum(min(old[j], total / shards) for j in range(shards))
        moved = sum(n for o, k, n in blocks if new[o, k] != o)
        assert moved <= least + 50 * shards


def test_permutations_have_each_place_once(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        df = spark.range(n).withColumn("key", F.explode(F.array(*map(F.lit, range(3)))))
        got = df.select("key", mixing.permuted(F.col("id"), F.lit(n), F.col("key")).alias("p")).collect()
        places = {k: [r["p"] for r in got if r["key"] == k] for k in range(3)}
        assert all(sorted(p) == list(range(n)) for p in places.values())
        if n == 1000:
            assert places[0] != places[1] and places[0] != list(range(n))


def _plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """The excess reshared by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def test_targets_are_those_of_resharing(spark):
    draw = random.Random(9)
    for _ in range(6):
        sizes = {s: draw.choice([0, 1, 10, 500, 40000]) + draw.randrange(9) for s in [*draw.sample("abcdefgh", draw.randrange(1, 7)), None]}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = _plain_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in want)


def test_slots_take_each_block_in_turn(spark):
    plan = mixing.targets(spark.createDataFrame([("a", 4000), ("b", 900), (None, 77)], "source string, source_size long"))
    drawn = mixing.draws(plan, 8, 50, 2, 17)
    each = mixing.slots_of(drawn, 17).collect()
    wanted = {r["source"]: (r["blocks"], r["slots"]) for r in mixing.slots_in_all(plan, 8, 2, 17).collect()}
    total = Counter(r["shard"] for r in each)
    assert sorted(total) == list(range(len(total))) and all(total[k] == 50 for k in range(len(total) - 1))
    for source, (blocks, slots) in wanted.items():
        own = [r for r in each if r["source"] == source]
        assert sorted(r["slot"] for r in own) == list(range(slots))
        used = Counter(r["block"] for r in own)
        # every block comes once before any comes again
        assert {used[k] for k in range(blocks)} <= {slots // blocks, -(-slots // blocks)} and sum(used.values()) == slots
