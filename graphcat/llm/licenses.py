"""Licence scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form: A-Z lower-cased, copyright lines
dropped, every run of punctuation and white space one space, equivalent
spellings made equal. Whole texts are compared, by the SHA-256 of that form: a
document as a whole, and each of its lines and paragraphs (lines between lines
without a letter or digit) as a text of its own. The digests are joined with
those of the known texts, a table in this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .known_licenses import EQUIVALENT, NOTICES, TEXTS
from .tables import carried, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9])|©|all rights reserved)[^\n]*"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WITHIN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY = "|".join(a for a, _ in EQUIVALENT)


def _equal(plain: Column) -> Column:
    """Equivalent spellings made equal."""
    equal = plain
    for a, b in EQUIVALENT:
        equal = F.regexp_replace(equal, rf"\b{a}", b)
    return F.when(plain.rlike(_ANY), equal).otherwise(plain)


def _lines(text: Column) -> Column:
    """The lines of a text, without copyright lines, all but letters and digits
    spaces."""
    low = F.regexp_replace(F.translate(text, UPPER, LOWER), f"(?md){COPYRIGHT_LINE}", " ")
    return F.transform(F.split(F.regexp_replace(low, WITHIN_LINE, " "), "\n", -1), lambda x: F.trim(x))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    return _equal(_joined(_lines(text)))


def known(spark: SparkSession) -> DataFrame:
    """(digest, license), one row a digest."""
    texts = spark.createDataFrame(NOTICES + TEXTS, "license string, text string")
    return texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (the carried columns), license (that of the whole text, else null),
    notices (licences that a line or a paragraph is the text of, distinct and
    sorted) and digest (of the whole text).

    A null text has null license and digest and no notices. A text without
    letters or digits matches nothing. Repeated documents each have a row.
    """
    docs = carried(docs, text, keep).withColumn("id", F.monotonically_increasing_id()).withColumn("lines", _lines(F.col("text")))
    paragraphs = F.filter(F.split(F.array_join("lines", "\n"), "\n\n+", -1), lambda x: F.contains(x, F.lit("\n")))
    units = F.array_distinct(F.filter(F.concat("lines", F.transform(paragraphs, lambda x: F.trim(F.translate(x, "\n", " ")))), lambda x: x != ""))
    unit = lambda line, x: F.struct(F.lit(line).alias("line"), x.alias("unit"))
    units = F.concat(F.array(unit(0, _joined(F.col("lines")))), F.transform(units, lambda x: unit(1, x)))
    # every document keeps a row, and a task sums up its own rows before the exchange
    each = docs.select("id", "row", F.explode_outer(units).alias("u")).select("id", "row", "u.line", F.sha2(_equal(F.col("u.unit")), 256).alias("digest"))
    hits = each.join(licenses, "digest", "left")
    whole = F.max(F.when(F.col("line") == 0, F.col("license")))
    return hits.groupBy("id", "row").agg(whole.alias("license"), F.array_sort(F.collect_set(F.when(F.col("line") == 1, F.col("license")))).alias("notices"), F.max(F.when(F.col("line") == 0, F.col("digest"))).alias("digest")).drop("id")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"), known(spark), keep=["doc_id"])
    return found.select("row.doc_id", "license", F.array_join("notices", ",").alias("notices"), "digest")


def _sql_canonical(text: str, copyright_lines: bool = True) -> str:
    low = f"translate({text}, '{UPPER}', '{LOWER}')"
    if copyright_lines:
        low = f"regexp_replace({low}, '(?m){COPYRIGHT_LINE}', ' ', 'g')"
    plain = f"trim(regexp_replace({low}, '{OTHER}', ' ', 'g'))"
    for a, b in EQUIVALENT:
        plain = f"regexp_replace({plain}, '\\b{a}', '{b}', 'g')"
    return plain


def _sql_known() -> str:
    return ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in NOTICES + TEXTS)


_WITHOUT = f"regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT_LINE}', ' ', 'g')"
_PARTS = f"list_concat(string_split(low, chr(10)), string_split_regex(regexp_replace(low, '(?m)^{WITHIN_LINE}$', '', 'g'), '\\n\\n+'))"
OP8_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(l) AS license FROM (VALUES {_sql_known()}) AS v(l, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WITHOUT} AS low FROM documents),
w AS (SELECT r, doc_id, sha256({_sql_canonical("text")}) AS digest FROM d),
l AS (SELECT r, sha256({_sql_canonical("part", False)}) AS digest FROM d, unnest({_PARTS}) AS t(part)),
n AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT r, license FROM l JOIN k USING (digest)) GROUP BY r)
SELECT doc_id, license, coalesce(notices, '') AS notices, digest FROM w LEFT JOIN k USING (digest) LEFT JOIN n USING (r)
"""
