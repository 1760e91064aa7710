"""Personal data by candidate gradient boosting, with DataFrame functions only.

Four strict patterns give the base spans, which always stay. Four loose ones
propose more, overlapping them and each other. Every proposal has features of
its format and its context, each with a few values. All proposals of all
documents are counted by features, label, and fold, which gives a table whose
size is bounded by the features, not by the data.

The label is evidence that neither the strict patterns nor the features hold:
the value is brought to its usual spelling and put to the checks of its kind
(the address ends in letters, the checksum holds, parts are below 256, there are
as many digits as a number can have). Features are only how a value is written
and what stands around it, so the trees learn which ways of writing belong to
values that pass, and take a value that is written that way.
Boosted trees are fitted to those counts, become plain column expressions, and
a proposal is added where its score passes the threshold of its kind, the
lowest at which the precision on the fold left out of training is met.

Places are found without walking a text: every match is put between marks, the
text is split there, and running sums of lengths give the code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import carried, read, written

KINDS = ("email", "ip", "card", "phone")

# The base patterns, as the contract gives them. Possessive loops and the
# look-behinds take the same matches and keep long runs linear: a match that
# fails from the start of a run fails from any later place in it, but where the
# match before it ended within the run (\G). A card has twelve digits at least; a
# run with fewer has no match from any place in it.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\x20?[.]\x20?[0-9]++){3}",
    "card": r"[0-9](?:[\x20./-]?[0-9]){7,}+",
    "phone": r"(?:\+|\(|\b00)[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
}
#: What a text with a match holds; cheaper to look for than the match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MARK, OTHER_MARK = "\x01", "\x02"  #: in no pattern
CONTEXT = 24  #: code points on either side that give features
CUES = {
    "email": "mail|contact|write|@",
    "ip": "ip|host|addr|server|login",
    "card": "card|visa|credit|pay|number",
    "phone": "phone|tel|call|mobile|fax|contact",
}
FEATURES = ("kind", "digits", "length", "separators", "kinds", "opens", "even", "before", "after", "cue")
ROUNDS, DEPTH, RATE, PRECISION = 24, 3, 0.3, 0.99


def digits(value: str) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.coalesce(F.aggregate(at, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0, F.lit(False))


def octets(value: str) -> Column:
    parts = F.transform(F.split(value, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))


def passes(kind: str = "kind", value: str = "value") -> Column:
    """The checks of the base kinds on a match of their pattern."""
    n = F.length(digits(value))
    return (
        F.when(F.col(kind) == "email", F.lit(True))
        .when(F.col(kind) == "ip", octets(value))
        .when(F.col(kind) == "card", n.between(12, 19) & luhn(digits(value)))
        .otherwise(n.between(9, 15))
    )


def address(value: str = "value") -> Column:
    """A value with at and dot in brackets spelled as signs."""
    at = F.regexp_replace(value, r"\x20?[(\[]at[)\]]\x20?", "@")
    return F.regexp_replace(at, r"\x20?[(\[]dot[)\]]\x20?", ".")


def evidence() -> Column:
    """The label of a proposal, whatever the strict patterns take: in its usual
    spelling the value passes the checks of its kind, and no letter or digit
    goes on beside it."""
    n = F.length(digits("value"))
    ends = F.coalesce(F.right("before", F.lit(1)).rlike("[A-Za-z0-9]"), F.lit(False)) | F.coalesce(F.left("after", F.lit(1)).rlike("[A-Za-z0-9]"), F.lit(False))
    checked = (
        F.when(F.col("kind") == "email", address("value").rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"))
        .when(F.col("kind") == "ip", octets("value") & (n >= 6))
        .when(F.col("kind") == "card", n.between(12, 19) & luhn(digits("value")))
        .otherwise(n.between(9, 15))
    )
    return F.coalesce(checked & ~ends, F.lit(False))


def proposals(docs: DataFrame, text: str = "text", keep: list[str] | None = None, id_column: str | None = None) -> DataFrame:
    """One row per match of a pattern, and one for each document without any:
    (id, row, fold, strict, kind, value, start, end, before, after)."""
    plain = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER_MARK)
    docs = carried(docs, text, keep).withColumns({"id": F.monotonically_increasing_id(), "text": plain})
    docs = docs.withColumn("fold", (F.pmod(F.xxhash64("text"), F.lit(5)) == 0))

    def parts(strict: bool, kind: str, pattern: str) -> Column:
        """The text before the first match, the match, the text after it, and so on."""
        cut = F.split(F.regexp_replace("text", pattern, f"{MARK}$0{MARK}"), MARK, -1)
        return F.when(F.contains("text", F.lit(NEEDS[kind])), cut) if strict and NEEDS[kind] else cut

    found = [F.struct(F.lit(strict).alias("strict"), F.lit(kind).alias("kind"), parts(strict, kind, p).alias("parts")) for strict, patterns in ((True, STRICT), (False, LOOSE)) for kind, p in patterns.items()]
    lists = docs.select("id", "row", "fold", F.explode_outer(F.filter(F.array(*found), lambda x: F.size(x["parts"]) > 1)).alias("x"))
    at = lambda i: F.get("x.parts", i)
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("x.parts") / 2).cast("int")), lambda i: F.struct(F.length(at(2 * i)).alias("gap"), F.left(at(2 * i), F.lit(CONTEXT)).alias("head"), F.right(at(2 * i), F.lit(CONTEXT)).alias("tail"), at(2 * i + 1).alias("value")))
    each = lists.select("id", "row", "fold", F.col("x.strict").alias("strict"), F.col("x.kind").alias("kind"), F.posexplode_outer(F.when(F.col("x.kind").isNotNull(), cut)).alias("i", "m")).repartition("id")
    by_place = Window.partitionBy("id", "strict", "kind").orderBy("i")
    size = F.coalesce(F.length("m.value"), F.lit(0))
    each = each.withColumn("end", F.sum(F.col("m.gap") + size).over(by_place)).withColumn("after", F.lead("m.head").over(by_place))
    each = each.filter("kind IS NULL OR m.value IS NOT NULL")
    return each.select("id", "row", "fold", "strict", "kind", F.col("m.value").alias("value"), (F.col("end") - F.length("m.value")).alias("start"), "end", F.col("m.tail").alias("before"), "after")


def with_features(found: DataFrame) -> DataFrame:
    """Adds the features, small integers."""
    n, size = F.length(digits("value")), F.length("value")
    bins = lambda x, *cuts: sum(((x >= c).cast("int") for c in cuts), F.lit(0))
    marks = F.regexp_extract_all("value", F.lit(r"[^A-Za-z0-9]+"), F.lit(0))
    groups = F.filter(F.split("value", "[^0-9]+", -1), lambda g: g != "")
    cue = F.lit(False)
    for kind, words in CUES.items():
        cue = cue | ((F.col("kind") == kind) & F.lower("before").rlike(words))
    word = lambda c: c.rlike("^[A-Za-z0-9]$").cast("int") + 2 * c.rlike(r"^[.@_%+/-]$").cast("int")
    return found.withColumns(
        {
            "f_kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"),
            "f_digits": bins(n, 1, 7, 9, 11, 12, 13, 15, 16, 17, 20),
            "f_length": bins(size, 8, 12, 16, 20, 32, 64),
            "f_separators": bins(F.size(marks), 1, 2, 3, 4, 5),
            "f_kinds": bins(F.size(F.array_distinct(marks)), 1, 2, 3),
            "f_opens": F.when(F.startswith("value", F.lit("+")), 1).when(F.startswith("value", F.lit("(")), 2).when(F.startswith("value", F.lit("00")), 3).when(F.contains("value", F.lit("]")), 4).otherwise(0),
            # groups of digits of one length, as cards have
            "f_even": ((F.size(groups) > 1) & (F.size(F.array_distinct(F.transform(groups, F.length))) == 1)).cast("int"),
            "f_before": F.coalesce(word(F.right("before", F.lit(1))), F.lit(0)),
            "f_after": F.coalesce(word(F.left("after", F.lit(1))), F.lit(0)),
            "f_cue": cue.cast("int"),
        }
    )


def fit(counts: list[tuple[tuple[int, ...], bool, int]], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> list:
    """Boosted regression trees on the logistic loss. counts: (features, label,
    how many). A tree is a leaf's value or (feature, cut, left, right): left if
    the feature is below the cut."""
    cells: dict[tuple, list[float]] = {}
    for x, y, n in counts:
        cells.setdefault(x, [0, 0])[int(y)] += n
    keys = sorted(cells)
    margin = dict.fromkeys(keys, 0.0)
    trees = []

    def gain(g: float, h: float) -> float:
        return g * g / (h + 1)

    def grow(own: list[tuple], left: int, grad: dict, hess: dict):
        g, h = sum(grad[k] for k in own), sum(hess[k] for k in own)
        best = (1e-6, None)
        if left:
            for f in range(len(FEATURES)):
                sums: dict[int, list[float]] = {}
                for k in own:
                    s = sums.setdefault(k[f], [0.0, 0.0])
                    s[0] += grad[k]
                    s[1] += hess[k]
                a = b = 0.0
                values = sorted(sums)
                for v, cut in zip(values, values[1:], strict=False):
                    a, b = a + sums[v][0], b + sums[v][1]
                    best = max(best, (gain(a, b) + gain(g - a, h - b) - gain(g, h), (f, cut)), key=lambda x: (x[0], x[1] or ()))
        if best[1] is None:
            return rate * g / (h + 1)
        f, cut = best[1]
        return f, cut, grow([k for k in own if k[f] < cut], left - 1, grad, hess), grow([k for k in own if k[f] >= cut], left - 1, grad, hess)

    for _ in range(rounds if keys else 0):
        p = {k: 1 / (1 + math.exp(-margin[k])) for k in keys}
        grad = {k: cells[k][1] - p[k] * sum(cells[k]) for k in keys}
        hess = {k: p[k] * (1 - p[k]) * sum(cells[k]) for k in keys}
        tree = grow(keys, depth, grad, hess)
        trees.append(tree)
        for k in keys:
            margin[k] += leaf(tree, k)
    return trees


def leaf(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


def margin_column(trees: list) -> Column:
    def column(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(F.col(f"f_{FEATURES[tree[0]]}") < tree[1], column(tree[2])).otherwise(column(tree[3]))

    return sum((column(t) for t in trees), F.lit(0.0))


def thresholds(trees: list, held: list[tuple[tuple[int, ...], bool, int]], precision: float = PRECISION) -> dict[int, float]:
    """For each kind, the lowest margin at which the given precision holds on
    the proposals held out, from the highest margin down; none if it never does."""
    by_kind: dict[int, dict[float, list[int]]] = {}
    for x, y, n in held:
        by_kind.setdefault(x[0], {}).setdefault(sum(leaf(t, x) for t in trees), [0, 0])[int(y)] += n
    out = {}
    for kind, scores in by_kind.items():
        bad = good = 0
        for m in sorted(scores, reverse=True):
            bad, good = bad + scores[m][0], good + scores[m][1]
            if good >= precision * (bad + good):
                out[kind] = m
    return out


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, precision: float = PRECISION) -> DataFrame:
    """row (the carried columns), base and spans: arrays of (start, order, end,
    kind), sorted; places in code points, end exclusive. base holds the strict
    matches that pass their checks, spans these and the proposals added.

    A null or empty text has none. Repeated documents each have a row.
    """
    found = proposals(docs, text, keep).withColumn("base", F.col("strict") & passes())
    found = found.withColumn("base", F.coalesce("base", F.lit(False)))
    found = written(with_features(found).withColumn("label", evidence()))
    names = [f"f_{f}" for f in FEATURES]
    # the number of rows is at most the product of the features' values
    cells = found.filter("NOT strict").groupBy("fold", "label", *names).count().collect()
    counts = [(r["fold"], tuple(r[f] for f in names), r["label"], r["count"]) for r in cells]
    trees = fit([c[1:] for c in counts if not c[0]])
    limits = thresholds(trees, [c[1:] for c in counts if c[0]], precision)
    limit = F.lit(float("inf"))
    for kind, m in limits.items():
        limit = F.when(F.col("f_kind") == kind, F.lit(m)).otherwise(limit)
    # an end in sight of the rounding of sums
    chosen = F.col("base") | (~F.col("strict") & (margin_column(trees) >= limit - 1e-9))
    span = F.struct("start", F.col("f_kind").alias("order"), "end", "kind")
    return found.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(F.when(chosen, span))).alias("spans")).drop("id")


def spelled(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(found: DataFrame, text: str = "row.text", spans: str = "spans") -> DataFrame:
    """Adds redacted: the text with each run of overlapping spans replaced by
    the name of its first one in brackets."""
    runs = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"), F.element_at(a, -1)["kind"].alias("kind"))))).otherwise(F.concat(a, F.array(F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["kind"].alias("kind"))))))
    out = found.withColumn("_runs", runs)
    pieces = F.transform("_runs", lambda r, i: F.concat(F.substring(F.col(text), F.coalesce(F.when(i > 0, F.element_at("_runs", F.greatest(i, F.lit(1)))["end"]), F.lit(0)).cast("int") + 1, (r["start"] - F.coalesce(F.when(i > 0, F.element_at("_runs", F.greatest(i, F.lit(1)))["end"]), F.lit(0))).cast("int")), F.lit("["), r["kind"], F.lit("]")))
    rest = F.substring(F.col(text), F.coalesce(F.when(F.size("_runs") > 0, F.element_at("_runs", -1)["end"]), F.lit(0)).cast("int") + 1, F.length(F.col(text)))
    return out.withColumn("redacted", F.concat(F.array_join(pieces, ""), rest)).drop("_runs")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *(count(k) for k in KINDS), F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
