"""Column expressions over whole tables: predicates, ids, links, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def edge_display(edge_type: Column | str, value: Column | str) -> Column:
    """Label, kind or link of an edge; control edges show none."""
    return F.when(_c(edge_type) != "control", _c(value))


def artifact_id_valid(x: Column | str) -> Column:
    """A relative path ending in .json without empty, . or .. segments or backslashes."""
    x = _c(x)
    parts = F.forall(F.split(x, "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(x.endswith(".json") & ~x.contains("\\") & parts, F.lit(False))


def generator_ref_valid(x: Column | str) -> Column:
    """source:id, with a known source and a kebab-case id."""
    return F.coalesce(_c(x).rlike("^(built-in|global|project):[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def revision_id_valid(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def utc_datetime_valid(x: Column | str) -> Column:
    """Strict UTC: date, T, time, optional fraction, Z; a real date and time."""
    x = _c(x)
    shape = x.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?Z$")
    return F.coalesce(shape & F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))


def canvas_id(layout: Column | str, artifact: Column | str) -> Column:
    """behavior:<id> for sequences and flowcharts, design:<id> for the rest."""
    return F.concat_ws(":", F.when(_c(layout).isin("sequence", "flowchart"), "behavior").otherwise("design"), _c(artifact))


def annotation_etag(revision: Column | str, document: Column | str) -> Column:
    return F.concat(F.lit('"sha256:'), F.sha2(F.concat_ws("\n", _c(revision), _c(document)), 256), F.lit('"'))


def encode_segment(x: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_.!~*'() as they are."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, c in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def source_href(path: Column | str) -> Column:
    return F.concat(F.lit("source:///"), F.array_join(F.transform(F.split(_c(path), "/"), encode_segment), "/"))


def parse_source_href(href: Column | str) -> Column:
    """STRUCT(path, line, end_line, error): the first error, else the place."""
    h = _c(href)
    body = F.regexp_extract(h, r"^source:(?://)?([^?#]*)", 1)
    rest = F.regexp_extract(h, r"^source:(?://)?[^?#]*(.*)$", 1)
    path = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B")))
    fragment = F.regexp_extract(rest, "#(.*)$", 1)
    line = F.regexp_extract(fragment, r"^L([1-9][0-9]*)(?:-L?([1-9][0-9]*))?$", 1)
    end = F.regexp_extract(fragment, r"^L([1-9][0-9]*)(?:-L?([1-9][0-9]*))?$", 2)
    number = lambda x: F.when(x != "", x.cast("long"))
    error = (
        F.when(h.isNull() | ~h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "url")
        .when(~h.rlike("^source:") | rest.startswith("?") | h.rlike("^source://[^/?#]"), "scheme")
        .when(path.isNull(), "encoding")
        .when(~path.startswith("/") | path.startswith("//") | path.contains("\\"), "relative")
        .when((path == "/") | F.array_contains(F.split(path, "/"), ".."), "outside")
        .when((fragment != "") & (line == ""), "fragment")
        .when(number(end) < number(line), "range")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, F.substr(path, F.lit(2))).alias("path"), F.when(ok, number(line)).alias("line"), F.when(ok, number(end)).alias("end_line"), error.alias("error"))


def link_label(text: Column | str, href: Column | str) -> Column:
    """A link's text, else the file name of a source link, else the link. The name
    stays encoded, and what a URL does not hold as it is gets encoded."""
    text, href = _c(text), _c(href)
    name = F.element_at(F.split(F.regexp_extract(href, "^source:(?://[^/?#]*)?([^?#]*)", 1), r"[\\/]"), -1)
    odd = lambda x: F.when(x.rlike("^[\\x20-\\x7E]$") & ~x.rlike("[ \"<>`{}^]"), x).otherwise(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    name = F.array_join(F.transform(F.regexp_extract_all(name, F.lit("(?s)(.)"), F.lit(1)), odd), "")
    return F.coalesce(F.when(text != "", text), F.when(href.startswith("source:") & ~name.isin("", ".", ".."), name), href)


def package_name(specifier: Column | str, resolved: Column | str) -> Column:
    """The package below the last node_modules of a path, else that of a bare
    specifier; null for relative, absolute and # ones."""
    s, r = _c(specifier), F.replace(_c(resolved), F.lit("\\"), F.lit("/"))
    below = F.regexp_extract(r, r"^(?:.*/)?node_modules/((?:@[^/]+/[^/]+|[^@/][^/]*))(?:/.*)?$", 1)
    bare = F.regexp_extract(s, r"^(@[^/]+/[^/]+|[^@#./][^/]*)", 1)
    return F.coalesce(F.when(below != "", below), F.when(bare != "", bare))


def dependency_edge_id(source: Column | str, target: Column | str, kind: Column | str) -> Column:
    return F.concat_ws(":", F.lit("dependency"), encode_segment(_c(source)), encode_segment(_c(target)), _c(kind))


def hashed_id(*parts: Column | str) -> Column:
    """16 hex digits of a digest, for derived ids."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *map(_c, parts)), 256), 1, 16)


def to_definition_id(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "@[0-9a-f]{16}$", "")


def normalize_condition_label(x: Column | str) -> Column:
    """Pairs of leading ! fold away."""
    return F.regexp_replace(_c(x), r"^(?:!\s*!\s*)+", "")


def _whole_group(x: Column) -> Column:
    """Whether the first parenthesis closes at the very end."""
    depth = F.aggregate(F.split(F.substr(x, F.lit(1), F.length(x) - 1), ""), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), (a["ok"] & ((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)) > 0)).alias("ok")))
    return x.startswith("(") & x.endswith(")") & depth["ok"]


def positive_label(x: Column | str) -> Column:
    """The label without its leading !, and without parentheses that then
    enclose all of it."""
    x = normalize_condition_label(x)
    bare = F.regexp_replace(x, r"^!\s*", "")
    inner = F.substr(bare, F.lit(2), F.length(bare) - 2)
    return F.when(x.startswith("!") & _whole_group(bare), inner).otherwise(bare)


def negate_label(x: Column | str) -> Column:
    """! in front; compound labels in parentheses; a negated label loses its !."""
    x = normalize_condition_label(x)
    compound = x.rlike(r"\s|&&|\|\||[?:<>=]") & ~_whole_group(x)
    return F.when(x.startswith("!"), positive_label(x)).when(compound, F.concat(F.lit("!("), x, F.lit(")"))).otherwise(F.concat(F.lit("!"), x))


def polarity_pair(kind: Column | str, marked: Column | str, cases: Column | str) -> Column:
    """STRUCT(on_case, off_case) of a marked branch of two cases, else null."""
    pair = F.struct(F.try_element_at(_c(cases), F.lit(1)).alias("on_case"), F.try_element_at(_c(cases), F.lit(2)).alias("off_case"))
    return F.when((_c(kind) == "branch") & F.coalesce(_c(marked), F.lit(False)) & (F.size(_c(cases)) == 2), pair)


def parent_path(x: Column | str) -> Column:
    """The directory of a path; the empty one at the top."""
    return F.regexp_replace(_c(x), "/?[^/]*$", "")


def is_path_inside(base: Column | str, x: Column | str) -> Column:
    base = F.regexp_replace(_c(base), "/+$", "")
    return (_c(x) == base) | F.startswith(_c(x), F.concat(base, F.lit("/"))) | (base == "")


def glob_regex(pattern: str) -> str:
    """A glob with *, ** and ? as an anchored pattern: ** crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if pattern[i] in r"\.+()[]{}^$|" else "") + pattern[i], i + 1
    return f"^{out}$"
