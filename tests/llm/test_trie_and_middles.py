"""Prefix trie and fill-in-the-middle against plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphcat.llm import fim, trie

TURNS = "conv_id long, turn int, role string, text string, id long, depth string, conv string"


def random_turns(seed):
    """Conversations with shared beginnings, copies, ties, nulls, one of many turns."""
    rng = random.Random(seed)
    out = []
    for c in [*range(0, 14), 100, 101, 130, 205, 206, 299, -3, None]:
        n = 23 if c == 7 else rng.randrange(1, 8)
        for t in range(n):
            turn = rng.choice([None, t, t, t, t])
            out.append((c, turn, rng.choice(["user", "user", None]), rng.choice(["", "é", "abc", None]), 1, "d", "c"))
    out += [(50 + k, t, "user", f"same {t}", 1, "d", "c") for k in range(5) for t in range(9)]
    return [*out, out[3], out[3]]


def plain(r):
    return r[2] or "", r[3] or ""


def brute_rebuilt(rows):
    own = collections.defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append(plain(r))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    return {c: own.get(base(c), [])[: h[c]] + own[c][h[c] :] for c in own}


def brute_trie(paths):
    nodes = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    out = collections.Counter()
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(paths[c]) == len(p)))
        out[min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(q not in kids for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(convs, turns):
    return collections.Counter(tuple(r) for r in trie.prefix_trie(convs, turns).collect())


@pytest.mark.parametrize("seed,level", [(1, trie.LEVEL), (2, 2)])
def test_prefix_trie(spark, monkeypatch, seed, level):
    monkeypatch.setattr(trie, "LEVEL", level)
    monkeypatch.setattr(trie, "ENDS_BITS", 1)
    rows = random_turns(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert found(*trie.rebuilt(trie.ordered(df))) == brute_trie(brute_rebuilt(rows))


def test_prefix_trie_of_one_conversation_in_many_ranges(spark):
    """A conversation that holds most rows is numbered range by range."""
    rows = [(7, t, "user", f"turn {t}", 1, "d", "c") for t in range(300)] + [(8, t, "user", f"turn {t}", 1, "d", "c") for t in range(150)]
    turns = trie.ordered(spark.createDataFrame(rows, TURNS).repartition(6))
    assert {(r["conv"], r["i"]) for r in turns.collect()} == {(c, t + 1) for c, t, *_ in rows}
    convs = turns.select("conv").distinct()
    assert found(convs, turns) == brute_trie({c: [plain(r) for r in rows if r[0] == c] for c in (7, 8)})


def test_prefix_trie_without_turns(spark):
    nothing = spark.createDataFrame([], TURNS)
    assert found(*trie.rebuilt(trie.ordered(nothing))) == {}
    # 101 takes its first turns from conversation 100, which is not there
    rows = [(c, 0, "user", "x", 1, "d", "c") for c in (101, 102, 103) if zlib.crc32(str(c).encode()) % 6]
    assert rows
    got = found(*trie.rebuilt(trie.ordered(spark.createDataFrame(rows, TURNS))))
    assert got == brute_trie({r[0]: [] for r in rows})


TEXTS = ["", None, "a", "plain ascii text", "éüñ 😀 mixed 字", "has <P> inside", "<S>", "almost <P and <M", "<", "x" * 100_000 + "é", "S>M>P>" * 7, "<<<>>>" * 9]


def test_rotations_restore():
    rng = random.Random(3)
    for text in [t for t in TEXTS if t]:
        raw = text.encode()
        if any(s in raw for s in (b"<P>", b"<S>", b"<M>")):
            continue
        for _ in range(20):
            a, b = sorted(rng.randrange(len(raw) + 1) for _ in range(2))
            p, m, s = raw[:a], raw[a:b], raw[b:]
            assert fim.arranged(raw, a, b, "psm") == b"<P>" + p + b"<S>" + s + b"<M>" + m
            assert fim.arranged(raw, a, b, "spm") == b"<S>" + s + b"<P>" + p + b"<M>" + m
            for form in ("psm", "spm"):
                assert fim.restored_text(fim.arranged(raw, a, b, form), form) == raw


def test_fill_in_middle(spark):
    rows = [(i, t, i, "r", "f") for i, t in enumerate(TEXTS * 12)] + [(None, "no id", 1, "r", "f"), (5, "again", 1, "r", "f"), (5, "again", 1, "r", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, row string, form string")
    made = fim.restored(fim.fill_in_middle(df, F.col("doc_id")))
    got = collections.Counter((r["row"]["doc_id"], r["row"]["form"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made.collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        t = t or ""
        x = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or any(z in t for z in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want[d, "f", len(t), "plain", None, None, t, t] += 1
        elif h[3] % 100 < 20:
            want[d, "f", len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t] += 1
        else:
            want[d, "f", len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t] += 1
    assert got == want
    assert {k[3] for k in want} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(df.limit(0), F.col("doc_id"))).count() == 0
