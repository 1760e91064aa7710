"""Spans that the strict patterns miss are added."""

import random

from graphcat.llm import pii

from . import brute


def test_spans_beyond_the_base(spark):
    rng = random.Random(6)
    number = lambda k: "".join(rng.choice("23456789") for _ in range(k))
    texts, missed, wrong = [], [], []
    for i in range(400):
        words = " ".join(f"w{rng.randrange(99)}" for _ in range(4))
        name, host = f"n{number(3)}", f"h{number(2)}"
        kind = i % 5
        good = {0: f"({number(3)}) 555-{number(4)}", 1: f"{name} [at] {host} [dot] com", 2: f"+1 ({number(3)}) 555-{number(4)}", 3: f"{name}@{host}.org", 4: f"10.0.{rng.randrange(9)}.{rng.randrange(256)}"}[kind]
        bad = f"00{number(17)}" if i % 2 else f"({number(9)}{number(9)}"
        text = f"{words} {good} {words}; {bad}, {words}"
        texts.append((i, text))
        missed.append((text.index(good), text.index(good) + len(good), "phone" if kind in (0, 2) else "email" if kind in (1, 3) else "ip"))
        wrong.append(text.index(bad))
    got = pii.find(spark.createDataFrame(texts, "doc_id long, text string"))
    got = pii.redacted(got).collect()
    assert len(got) == 400
    for r in got:
        i, text = r["row"]["doc_id"], r["row"]["text"]
        spans = {(s["start"], s["end"], s["kind"]) for s in r["spans"]}
        assert missed[i] in spans, text
        assert not any(start == wrong[i] for start, *_ in spans - {(a, b, k) for a, _, b, k in brute.pii(text)}), text
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == [(a, k, b) for a, _, b, k in brute.pii(text)]
        assert text[missed[i][0] : missed[i][1]] not in r["redacted"]
