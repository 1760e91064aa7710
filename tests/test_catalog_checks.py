"""All rules over a catalog, free ids, labels of links and ends of routes."""

import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from graphcat.functions import exprs as X
from graphcat.operators import components as C
from graphcat.operators import hierarchy as H
from graphcat.operators import search
from graphcat.operators import validate as V
from graphcat.sources import artifacts as A

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["check_graphs", "aggregate_ids", "bundle_ids", "link_labels", "consumer_routes"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("customer", "lineitem", "orders", "part", "supplier", "nation", "region", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours = entry.queries()[name](spark, FOLDER)
    columns = sorted(ours.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, ours.select(columns).collect())) == Counter(want)


def _first_free(bases, reserved):
    """Plain: each base in order, a colon more while its id is used."""
    used, out = set(reserved), {}
    for name, base in bases:
        while base in used:
            base += ":"
        used.add(base)
        out[name] = base
    return out


def test_bundles_never_share_ids(spark):
    draw = random.Random(7)
    groups, reserved, want = [], [], set()
    for k in range(60):
        of = {draw.choice("ab") + ":" * draw.randrange(5) for _ in range(5)}
        ids = {"bundle:" + draw.choice("ab") + ":" * draw.randrange(6) for _ in range(4)} | {"x", "bundle"}
        groups += [(str(k), g) for g in of]
        reserved += [(str(k), r) for r in ids]
        want |= {(str(k), *i) for i in _first_free([(g, "bundle:" + g) for g in sorted(of)], ids).items()}
    got = H.bundle_ids(spark.createDataFrame(groups, "artifact_id string, group_id string"), spark.createDataFrame(reserved, "artifact_id string, id string"))
    assert {tuple(r) for r in got.collect()} == want


def test_aggregate_ids(spark):
    ends = spark.createDataFrame([("a", 'x"y', "z"), ("a", 'x"y', "z"), ("b", 'x"y', "z"), ("a", "p", "q")], "artifact_id string, source_id string, target_id string")
    reserved = spark.createDataFrame([("a", r'aggregate:["x\"y","z"]'), ("a", r'aggregate:["x\"y","z"]::'), ("a", 'aggregate:["p","q"]:')], "artifact_id string, id string")
    got = {(r.artifact_id, r.source_id): r.aggregate_id for r in H.aggregate_ids(ends, reserved).collect()}
    assert got == {("a", 'x"y'): r'aggregate:["x\"y","z"]:', ("b", 'x"y'): r'aggregate:["x\"y","z"]', ("a", "p"): 'aggregate:["p","q"]'}
    assert H.aggregate_ids(ends.limit(0), reserved.limit(0)).count() == 0


def test_link_labels(spark):
    cases = [
        ("Own", "source:///a/b.ts", "Own"),
        ("", "source:///a/b.ts#L3", "b.ts"),
        (None, "source:///a/%5Bid%5D.ts", "%5Bid%5D.ts"),
        (None, "source:///a/b cé\U0001f600.ts", "b%20c%C3%A9%F0%9F%98%80.ts"),
        (None, "source:a\\b.ts", "b.ts"),
        (None, "source:///a/", "source:///a/"),
        (None, "source:///a/..", "source:///a/.."),
        (None, "source://host", "source://host"),
        (None, "https://x/y.ts", "https://x/y.ts"),
        (None, None, None),
    ]
    df = spark.createDataFrame([(k, t, h) for k, (t, h, _) in enumerate(cases)], "k int, text string, href string")
    got = [r[1] for r in df.select("k", X.link_label("text", "href")).sort("k").collect()]
    assert got == [want for *_, want in cases]


def test_inventory_of_documents(spark):
    raw = """{"title": "T", "generator": "g", "links": [{"href": "https://a/b"}], "diagram": {"layout": {"id": "general"}, "graph": {"groups": [],
      "nodes": [{"nodeId": "n", "title": "N", "links": [{"text": "Code", "href": "source:///x.ts"}, {"href": "source:///d/y.ts"}]}],
      "edges": [{"edgeId": "e", "sourceNodeId": "n", "targetNodeId": "n", "href": "source:///z.ts"}, {"edgeId": "f", "sourceNodeId": "n", "targetNodeId": "n"}]}}}"""
    parsed = A.parse_artifacts(spark.createDataFrame([("s", "a.json", raw)], "scope_id string, artifact_id string, raw string"))
    tables = A.explode_graph(parsed)
    got = {(r.scope_id, r.kind, r.element_id, r.link_ix, r.label) for r in search.link_inventory(tables["links"], tables["edges"]).collect()}
    assert got == {("s", "artifact", None, 0, "https://a/b"), ("s", "node", "n", 0, "Code"), ("s", "node", "n", 1, "y.ts"), ("s", "edge", "e", 0, "z.ts")}
    # the tables of documents as they are: one edge names itself, nothing else is wrong
    assert V.check_graphs(parsed.select("scope_id", "artifact_id", "layout_id"), tables).count() == 0


def _plain_routes(supplied, rules, analyzed):
    out = set()

    def walk(value, kind, at, prop, visited):
        if (at, prop) in visited:
            return
        if at not in analyzed:
            if not (kind == "render-prop" and prop[:2] == "on" and prop[2:3].isupper()):
                out.add((value, at, prop, kind))
            return
        for component, name, what, to, to_prop, excluded, of in rules:
            if component != at or not (name == prop or name == "*" and prop not in (excluded or [])):
                continue
            if what == "forward":
                walk(value, kind, to, prop if name == "*" else to_prop, visited | {(at, prop)})
            elif of in (None, kind):
                out.add((value, at, prop, kind))

    for s in supplied:
        walk(s[0], s[3], s[1], s[2], frozenset())
    return out


def test_ends_of_routes(spark):
    draw = random.Random(3)
    props = ["children", "onClick", "on", "icon"]
    rules = []
    for _ in range(40):
        star = draw.random() < 0.3
        rules.append((draw.randrange(9), "*" if star else draw.choice(props), "forward", draw.randrange(12), draw.choice(props), draw.sample(props, 1) if star and draw.random() < 0.7 else None, None))
    rules += [(draw.randrange(9), draw.choice(props), "render", None, None, None, draw.choice([None, "slot", "render-prop"])) for _ in range(12)]
    supplied = [(f"v{k}", draw.randrange(12), draw.choice(props), draw.choice(["slot", "render-prop"])) for k in range(12)]
    analyzed = list(range(8))
    r = spark.createDataFrame(rules, "component int, prop string, kind string, to_component int, to_prop string, excluded array<string>, value_kind string")
    s = spark.createDataFrame(supplied, "value_id string, component int, prop string, value_kind string")
    known = spark.createDataFrame([(k,) for k in analyzed], "component int")
    want = _plain_routes(supplied, rules, set(analyzed))
    assert {tuple(x) for x in C.consumer_routes(s, r, known).collect()} == want and want
    # without kinds and without the analysed ones
    ruled = {x[0] for x in rules}
    plain = {x[:3] for x in _plain_routes([(*x[:3], "") for x in supplied], [x[:6] + (None,) for x in rules], ruled)}
    assert {tuple(x) for x in C.consumer_routes(s.drop("value_kind"), r.drop("value_kind")).collect()} == plain


def test_scopes_are_not_mixed(spark):
    """One artifact of two scopes: whole in one, without its node in the other."""
    at = [("s", "a"), ("t", "a")]
    made = lambda rows, schema: spark.createDataFrame(rows, "scope_id string, artifact_id string, " + schema)
    none = lambda schema: made([], schema)
    tables = {
        "groups": none("group_id string, parent_group_id string, type string, ordinal int"),
        "nodes": made([(*a, n, None, "default", k) for a in at for k, n in enumerate("xy") if (a[0], n) != ("t", "y")], "node_id string, group_id string, type string, ordinal int"),
        "edges": made([(*a, "e", "x", "y", "default", 0) for a in at], "edge_id string, source_node_id string, target_node_id string, type string, ordinal int"),
        "activations": none("node_id string, activation_id string, ordinal int, start_message_id string, start_endpoint string, end_message_id string, end_endpoint string"),
        "branches": none("fragment_id string, branch_id string, ordinal int, start_message_id string, end_message_id string"),
        "roots": none("ordinal int, node_id string"),
        "controls": none("control_id string, type string, owner_node_id string, ordinal int"),
        "cases": none("control_id string, case_id string, ordinal int"),
        "aux_definitions": none("definition_id string, ordinal int"),
        "requirements": none("edge_id string, rule_ix int, req_ix int, control_id string, value string"),
        "prerequisites": none("control_id string, rule_ix int, req_ix int, req_control_id string, value string"),
    }
    artifacts = made([(*a, "general") for a in [*at, at[1]]], "layout_id string")
    got = sorted(tuple(r)[:2] + (r.code, r.message) for r in V.check_graphs(artifacts, tables).collect())
    assert got == [("t", "a", "dangling_edges", "Diagram edge e targets unknown node y"), ("t", "a", "duplicate_artifacts", "Duplicate artifact path: a")]
    status = {r.scope_id: (r.status, r.n_issues) for r in V.catalog_status(artifacts.select("scope_id"), artifacts, V.check_graphs(artifacts, tables)).collect()}
    assert status == {"s": ("valid", 0), "t": ("invalid", 2)}
