"""Each operator against plain Python, on awkward texts, repeated rows, empty
tables and extra columns with clashing names."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from graphcat.llm import decontaminate, jaccard, langid, licenses, lm, mixing, pii, reshard, suffix_dedup

from . import brute


def multiset(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [200_000, 2])
def test_decontaminate(spark, docs, rows, block):
    items = [(1, rows[40][1]), (2, "w1 w2"), (3, None), (4, "!!"), (None, "w5"), (1, rows[43][1][:40])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.with_verdict(decontaminate.find_passages(docs, bench, keep=["doc_id"], block_windows=block))
    got = collections.Counter((r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got.collect())
    windows = []
    for i, t in items:
        w = brute.words(t, True)
        windows += [(i, w[k : k + 13]) for k in range(max(1, len(w) - 12))] if w else []
    want = collections.Counter()
    for d, t, *_ in rows:
        w, hit, names = brute.words(t, True), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    if i is not None:
                        names.add(str(i))
        want[d, len(w), len(hit), tuple(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    assert got == want


def test_decontaminate_empty(spark, docs, rows, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_passages(docs, bench).filter("size(spans) > 0").count() == 0
    assert decontaminate.find_passages(docs, bench).count() == len(rows)
    assert decontaminate.find_passages(nothing, bench).count() == 0


@pytest.mark.parametrize("large,singles", [(256, 160), (2, 160), (2, 0)])
def test_jaccard(spark, docs, rows, monkeypatch, large, singles):
    monkeypatch.setattr(jaccard, "LARGE", large)
    got = jaccard.join_groups(docs, keep=["doc_id"])
    got = collections.Counter((r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in got.collect())
    assert got == collections.Counter(brute.components([(d, t) for d, t, *_ in rows]))


def test_jaccard_chain_of_near_copies(spark, monkeypatch):
    """Variants of one text of which some are linked only with each other."""
    import random

    rng = random.Random(2)
    base = [f"b{i}" for i in range(70)]
    texts = []
    for k in range(60):
        w = list(base)
        for p in rng.sample(range(70), k % 4):
            w[p] = f"m{rng.randrange(12)}"
        texts.append((k * 3, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for large in (2, 8, 256):
        monkeypatch.setattr(jaccard, "LARGE", large)
        got = jaccard.join_groups(df).collect()
        assert sorted((r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in got) == sorted(brute.components(texts))


def test_jaccard_combination_keys():
    """Similar sets share as many keys as both say, whatever is frequent."""
    import numpy as np

    from graphcat.llm import words as W

    rng = np.random.default_rng(3)
    for n in (1, 5, 20, 150, 158, 400):
        for floor in (0, 40, 10**9):
            a = W.mix(np.arange(n, dtype=np.uint64) + np.uint64(n))
            change = n // 20
            b = np.unique(np.concatenate([a[change:], W.mix(np.arange(change, dtype=np.uint64) + np.uint64(10**6))]))
            if 100 * (n - change) < 90 * (n + change):
                continue
            table = rng.integers(0, 90, 1 << 16)
            est = lambda s: table[(s & np.uint64(0xFFFF)).astype(np.int64)]  # noqa: B023, E731
            (x, k), (y, m) = (jaccard.keys_of(np.unique(s), est(np.unique(s)), floor, floor + 30) for s in (a, b))
            assert min(k, m) >= 1
            assert len(np.intersect1d(x, y)) >= min(k, m)


def test_jaccard_nulls_and_empty(spark, nothing):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (2, "a b c d"), (9, None), (8, "")], "doc_id long, text string")
    got = {(r["row"]["doc_id"], r["n_shingles"], r["component"]) for r in jaccard.join_groups(df).collect()}
    assert got == {(None, 2, None), (3, 2, 2), (2, 2, 2), (9, 0, 9), (8, 0, 8)}
    assert jaccard.join_groups(nothing).count() == 0


@pytest.mark.parametrize("hot_from", [suffix_dedup.HOT, 3, 0])
def test_suffix_dedup(docs, rows, hot_from):
    """Also with windows of anchors that occur thrice, or of all, sent one by one."""
    got = suffix_dedup.remove_repeats(docs, keep=["doc_id"], hot_from=hot_from).collect()
    got = collections.Counter((r["row"]["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert got == collections.Counter(brute.repeats([(d, t) for d, t, *_ in rows]))


def test_suffix_dedup_edges(spark, nothing):
    same = "abcdefghij" * 9
    texts = [(1, same), (None, same), (2, "Z" + same), (3, "q" * 49), (4, "q" * 49), (5, "é" * 60), (6, None), (7, same[:50]), (8, "é" * 25)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["removed"])) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: (90, 0), None: (90, 0), 2: (91, 90), 3: (49, 0), 4: (49, 0), 5: (120, 0), 6: (0, 0), 7: (50, 50), 8: (50, 50)}
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_merge_of_front_coded_runs():
    import random

    import numpy as np

    from graphcat.llm import suffix_runs

    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(1, 40))) for _ in range(5)]
    coded = []
    for r in runs:
        m = np.frombuffer(b"".join(r), np.uint8).reshape(len(r), -1)
        coded.append(suffix_runs.encode(m, np.full(len(r), 12)))
    out = list(suffix_runs.merge([*coded, (b"", b"")]))
    assert [s for _, _, s in out] == sorted(x for r in runs for x in r)
    for (_, _, a), (n, _, b) in zip(out, out[1:], strict=False):
        assert n == next((i for i in range(12) if a[i] != b[i]), 12)


def test_language_id(spark, docs, rows, nothing):
    words = {"en": "the of and thing with", "es": "los que para niño está", "de": "und der straße über nicht"}
    import random

    rng = random.Random(4)
    train = [(" ".join(rng.choice(w.split()) for _ in range(30)), k) for k, w in words.items() for _ in range(20)]
    profiles = langid.train(spark.createDataFrame(train, "text string, lang string"), 512)
    tests = [(" ".join(rng.choice(w.split()) for _ in range(12)), k) for k, w in words.items() for _ in range(10)]
    got = langid.predict(spark.createDataFrame(tests, "text string, want string"), profiles, keep=["want"])
    assert got.filter("lang_pred <> row.want").count() == 0
    out = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, profiles, keep=["doc_id"]).collect()}
    assert all(0 <= s <= 1 for _, s in out.values())
    assert all(out[i] == ("und", 0.0) for i in range(4))
    assert langid.predict(docs, profiles).count() == len(rows)
    assert langid.predict(nothing, profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(nothing)).collect()} == {"und"}


def test_pii(docs, rows, nothing):
    got = pii.find(docs, keep=["doc_id"]).collect()
    spans = lambda a: tuple((s["start"], s["kind"], s["end"]) for s in a)
    want = collections.Counter((d, tuple((a, k, b) for a, _, b, k in brute.pii(t))) for d, t, *_ in rows)
    assert collections.Counter((r["row"]["doc_id"], spans(r["base"])) for r in got) == want
    assert all(set(spans(r["base"])) <= set(spans(r["spans"])) for r in got)
    assert pii.find(nothing).count() == 0
    red = pii.redacted(pii.find(docs.filter("doc_id = 43"))).first()
    assert "[email]" in red["redacted"] and "example.org" not in red["redacted"]


def test_pii_boosting():
    counts = [((1, k, 0, 0, 0, 0, 0, 0, 0, 0), k > 2, 50) for k in range(6)]
    trees = pii.fit(counts)
    limits = pii.thresholds(trees, counts)
    score = lambda x: sum(pii.leaf(t, x) for t in trees)
    assert all((score(x) >= limits[1]) == y for x, y, _ in counts)
    assert pii.fit([]) == [] and pii.thresholds([], []) == {}


def test_reshard(docs, rows, nothing, spark, tmp_path):
    placed = reshard.reshard(docs, reshard.old_shard_of_source(), F.col("doc_id"), shards=5)
    got = placed.collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["row"]["text"] or "").encode()) + 8
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = reshard.reshard(docs, reshard.old_shard_of_source(), F.col("doc_id"), shards=5)
    assert multiset(placed.select("row.doc_id", "shard")) == multiset(again.select("row.doc_id", "shard"))
    assert reshard.reshard(nothing, reshard.old_shard_of_source(), F.col("doc_id")).count() == 0


def test_min_cost_flow_moves_least():
    flow = reshard.min_cost_flow([10, 0, 2], [4, 4, 4], lambda i, j: int(i != j))
    assert flow == {(0, 0): 4, (0, 1): 4, (0, 2): 2, (2, 2): 2}
    blocks = [(0, k, 10) for k in range(60)] + [(1, k, 10) for k in range(20)]
    new = reshard.transfers(blocks, 4)
    sizes = collections.Counter(new.values())
    assert set(sizes.values()) == {20}
    assert sum(new[o, b] != o for o, b, _ in blocks) == 40


@pytest.mark.parametrize("slots", [1 << 17, 64])
def test_mixing(spark, docs, rows, nothing, slots):
    mixed = mixing.mix(docs, block=8, slots=slots)
    got = mixed.select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((d, len(brute.words(t))) for d, t, *_ in rows)
    total = sum(r["size"] for r in got)
    by = {r["source"]: [r["source_size"], r["target"], 0] for r in got}
    for r in got:
        by[r["source"]][2] += r["taken"]
    assert math.isclose(sum(t for _, t, _ in by.values()), 1.5 * total)
    for size, target, taken in by.values():
        assert target <= 2 * size + 1e-6
        # each shard draws a few slots; many small shards add up at random
        shards = math.ceil(1.5 * total / 8 / slots)
        assert abs(taken - target) <= 0.01 * target + 8 * (3 + 4 * math.sqrt(shards))
    texts = mixing.mixed_texts(mixed).collect()
    assert sum(len(brute.words(r["text"])) for r in texts) == sum(r["taken"] for r in got)
    again = mixing.mix(docs, block=8, slots=slots).select("row.doc_id", "size", "taken")
    assert multiset(mixed.select("row.doc_id", "size", "taken")) == multiset(again)
    assert mixing.mix(nothing).count() == 0


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 50), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # 300 to share by 3, 1, 2, 3; b stops at 20, null at 80
    assert got == pytest.approx({"a": 120.0, "b": 20.0, "c": 80.0, None: 80.0})


def test_licenses(spark, docs, rows, nothing):
    from graphcat.llm.known_licenses import TEXTS

    mit = dict(TEXTS)["MIT"]
    texts = [(1, "Copyright (c) 2020 A. Body\n\n" + mit.upper().replace("SUBLICENSE", "sub-license")), (2, "intro\nReleased under the MIT Licence!\nrest"), (3, mit + " but"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["row"]["doc_id"]: (r["license"], tuple(r["notices"])) for r in licenses.scan(df, licenses.known(spark)).collect()}
    assert got[1][0] == "MIT" and got[2] == (None, ("MIT",)) and got[3][0] is None and got[4] == got[5] == (None, ())
    assert licenses.scan(docs, licenses.known(spark)).count() == len(rows)
    assert licenses.scan(nothing, licenses.known(spark)).count() == 0


def test_lattice_sums_all_segmentations():
    import numpy as np

    from graphcat.llm.lattice import MARK, Vocabulary, score

    pieces = [(b"a", -1.0), (b"ab", -1.5), (b"b", -2.0), (MARK, -0.5), (MARK + b"a", -0.7), (MARK + b"abab", -3.0)]
    v = Vocabulary(pieces, np.full(256, -6.0))
    inner = {p: w for p, w in pieces if not p.startswith(MARK)}
    first = {p[len(MARK) :]: w for p, w in pieces if p.startswith(MARK)}

    def rest(s):
        if not s:
            return 1.0
        return sum(math.exp(w) * rest(s[len(p) :]) for p, w in inner.items() if s.startswith(p)) + math.exp(-6.0) * rest(s[1:])

    words = [b"abab", b"b", b"", b"zab", b"ab" * 40]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    got, expected = score(v, data, start, end, np.ones(len(words)))
    for w, g in list(zip(words, got, strict=True))[:4]:
        assert g == pytest.approx(math.log(sum(math.exp(x) * rest(w[len(p) :]) for p, x in first.items() if w.startswith(p))))
    lengths = np.array([1] * 256 + [len(p) for p in inner] + [len(p) for p in first])
    assert (expected * lengths).sum() == pytest.approx(len(data))


def test_lm(docs, rows, nothing):
    learns = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = lm.score_documents(docs, learns, keep=["doc_id"]).collect()
    counts, ends = collections.Counter(), 0
    for d, t, *_ in rows:
        if brute.crc(d) % 10:
            counts.update(brute.words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    texts = {d: t for d, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        w = brute.words(texts[r["row"]["doc_id"]])
        assert r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n and r["n_known"] == sum(x in counts for x in w) + 1
        assert r["base_score"] == pytest.approx(sum(log(counts[x]) for x in w) + log(ends))
        assert r["score"] <= 0 and math.isfinite(r["score"])
    assert lm.score_documents(nothing, learns).count() == 0
