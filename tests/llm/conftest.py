import os
import random
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, shard string"


@pytest.fixture(scope="session")
def spark(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
    return spark


def sentence(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_texts():
    """Awkward and ordinary texts: nulls, empty, punctuation, copies, near
    copies, shared passages, personal data, a long one."""
    rng = random.Random(5)
    base = sentence(rng, 60, 500)
    near = [" ".join("zz" if i == k else w for i, w in enumerate(base.split())) for k in (0, 30, 59)]
    passage = sentence(rng, 25, 400)
    plain = [sentence(rng, rng.randrange(1, 90)) for _ in range(25)]
    shared = [f"{sentence(rng, 10)} {passage} {sentence(rng, 5)}" for _ in range(4)]
    odd = [None, "", "   \n\t ", "...", "Ünï çödé ñandú", "a", "A b", "x" * 3000, "1.2.3.4.5 300.1.1.1 10.0.0.255"]
    pii = ["mail bob.x@example.org or +1 (555) 010-9999, card 4111 1111 1111 1111.", "a@b.c_x@d.e 4111111111111112 é +123456789"]
    long = [sentence(rng, 12000, 2000)]
    return odd + plain + [base, base, *near] + shared + pii + long


@pytest.fixture(scope="session")
def rows():
    texts = make_texts()
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", "s3", None][i % 4], None, 7, "r", "s") for i, t in enumerate(texts)]
    return [*out, out[10], out[34]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
