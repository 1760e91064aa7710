"""Fill-in-the-middle texts by rotating blocks of a byte buffer in place.

A text is prefix, middle and suffix, cut at two code points that a hash of its
key chooses. The three sentinels go into a bytearray of the text, each before
its part, and parts change places by rotations of three reversals. The same
rotations, told from where the sentinels stand, bring the text back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read
from .words import buffers, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are rearranged, and of these, those with the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned integers of 32 bits from a key; a null key counts as empty."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges buffer[start:middle] and buffer[middle:end]."""
    for a, b in ((start, middle), (middle, end), (start, end)):
        buffer[a:b] = buffer[a:b][::-1]


def arranged(text: bytes, first: int, second: int, form: str) -> bytes:
    """The text cut at two byte offsets, as psm or spm."""
    buffer = bytearray(text)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle, suffix, len(buffer))
    if form == "spm":
        rotate(buffer, 0, middle, middle + len(buffer) - suffix)
    return bytes(buffer)


def restored_text(output: bytes, form: str) -> bytes:
    """The text of which arranged() made output. No part holds a sentinel, so
    the first match of each is the one inserted."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    middle = buffer.find(MIDDLE)
    if form == "spm":
        rotate(buffer, 0, buffer.find(PREFIX), middle)
    suffix = buffer.find(SUFFIX)
    rotate(buffer, suffix, middle, len(buffer))
    for at, sentinel in ((suffix + len(buffer) - middle, SUFFIX), (suffix, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)


def _arrange(text: bytes, h: list[int], fim: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    n = len(starts)
    if not n or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "spm" if h[3] % 100 < spm else "psm"
    first, second = (int(starts[c]) if c < n else len(text) for c in (a, b))
    return n, form, a, b - a, arranged(text, first, second, form)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a text column of bounded bytes: first row, row past the last, texts."""
    offsets, data = buffers(column)
    for i, j in slices(offsets):
        yield i, j, [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]


def _with(batch: pa.RecordBatch, i: int, j: int, drop: set[str], **columns: pa.Array) -> pa.RecordBatch:
    kept = [(f, batch.column(f.name).slice(i, j - i)) for f in batch.schema if f.name not in drop]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[f.name for f, _ in kept] + list(columns))


def _string(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())


def fill_in_middle(docs: DataFrame, key: Column, text: str = "text", keep: list[str] | None = None, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """row (the carried columns), n (code points), form (plain, psm or spm),
    prefix_chars and middle_chars (null if plain) and output.

    key names the column or expression that draws the cuts, so that reruns agree
    and rows with one key and text become the same. A null text counts as empty;
    empty texts and those that hold a sentinel stay plain. Any column but text
    may be null or have any name; repeated rows are kept; no rows give none.
    """
    rows = docs.select(*(c.alias(f"h{i}") for i, c in enumerate(draws(key))), F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{k}").to_pylist() for k in range(4)]
            for i, j, texts in _texts(batch.column("text")):
                made = [_arrange(t, [x[i + k] for x in h], fim, spm) for k, t in enumerate(texts)]
                n, form, prefix, middle, output = zip(*made, strict=True)
                yield _with(batch, i, j, {"text", "h0", "h1", "h2", "h3"}, n=pa.array(n, pa.int64()), form=pa.array(form), prefix_chars=pa.array(prefix, pa.int64()), middle_chars=pa.array(middle, pa.int64()), output=_string(list(output)))

    schema = rows.select("row").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    return rows.mapInArrow(run, schema)


def restored(made: DataFrame) -> DataFrame:
    """made (of fill_in_middle) with the column restored: the text, told from
    output and form alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = batch.column("form").to_pylist()
            for i, j, texts in _texts(batch.column("output")):
                yield _with(batch, i, j, set(), restored=_string([restored_text(t, form[i + k]) for k, t in enumerate(texts)]))

    return made.mapInArrow(run, made.select("*").schema.add("restored", "string"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(read(spark, sf_dir, "documents"), F.col("doc_id"), keep=["doc_id"]))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


OP13_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), drawn AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT % (length(t) + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (length(t) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, t, n, form, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
    substr(t, 1, least(a, b)) AS prefix, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(t, greatest(a, b) + 1) AS suffix
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
