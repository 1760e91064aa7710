"""Documents read, parsed, exploded and written back."""

import json

from pyspark.sql import functions as F

from graphcat.sources import artifacts as A

GRAPH = {"groups": [{"groupId": "g", "title": "G"}], "nodes": [{"nodeId": "n", "type": "default", "title": "N", "groupId": "g"}, {"nodeId": "m", "type": "default", "title": "M", "synthetic": True}], "edges": [{"edgeId": "e", "type": "control", "sourceNodeId": "n", "targetNodeId": "m", "activeWhen": [[{"controlId": "c", "value": "on"}], []]}]}


def document(layout="general", **more):
    return json.dumps({"type": "design", "title": "T", "diagram": {"layout": {"id": layout}, "graph": GRAPH}, **more})


def test_catalog(spark, tmp_path):
    root = tmp_path / "scope"
    for path, text in {"a/x.diagram.json": document(), "node_modules/y.diagram.json": document(), "diagrams/z.json": document("nowhere"), "b/other.json": "{}", "b/bad.diagram.json": "{"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = A.read_catalog(spark, str(root), ignore=["node_modules/"])
    errors = {r["artifact_id"]: r["error"] for r in got.collect()}
    assert set(errors) == {"a/x.diagram.json", "diagrams/z.json", "b/bad.diagram.json"}
    assert errors["a/x.diagram.json"] is None and "nowhere" in errors["diagrams/z.json"] and "JSON" in errors["b/bad.diagram.json"]
    assert A.scope_status(got).first()["status"] == "invalid"


def test_explode_and_write_back(spark):
    texts = spark.createDataFrame([("s", "a.json", document(generator="built-in:flowchart"))], "scope_id string, artifact_id string, raw string")
    parsed = A.parse_artifacts(texts)
    assert parsed.first()["layout_id"] == "flowchart"
    t = A.explode_graph(parsed)
    assert [(r["node_id"], r["ordinal"], r["synthetic"]) for r in t["nodes"].orderBy("ordinal").collect()] == [("n", 0, False), ("m", 1, True)]
    assert [(r["rule_ix"], r["control_id"], r["value"]) for r in t["requirements"].collect()] == [(0, "c", "on")]
    envelopes = parsed.select("scope_id", "artifact_id", "document.type", "document.title", F.lit("general").alias("layout_id"))
    again = json.loads(A.documents_of(t, envelopes).first()["raw"])
    assert again["diagram"]["graph"]["groups"] == GRAPH["groups"]
    assert again["diagram"]["graph"]["nodes"][1]["synthetic"] is True and "synthetic" not in again["diagram"]["graph"]["nodes"][0]


def test_ids_keep_inner_folders(spark, tmp_path):
    root = tmp_path / "web"
    for path in ("a/web/x.diagram.json", "x.diagram.json", "a b/é+%.diagram.json"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("{}")
    assert {r["path"] for r in A.read_texts(spark, str(root)).collect()} == {"a/web/x.diagram.json", "x.diagram.json", "a b/é+%.diagram.json"}


FULL = {
    "type": "design", "title": "T", "updatedAt": "2026-01-01", "generator": "g", "instructions": "i", "vcs": {"commit": "c", "branch": "b"}, "links": [{"text": "t", "href": "source:///x"}, {"href": "https://e.org"}],
    "diagram": {
        "layout": {"id": "component-structure", "options": {"k": "v"}},
        "graph": {
            "groups": [{"groupId": "g", "type": "bounding", "title": "G", "description": "d", "hideTitle": True}, {"groupId": "h", "title": "H", "parentGroupId": "g", "synthetic": True}],
            "nodes": [
                {"nodeId": "n", "title": "N", "description": "d", "kind": "k", "groupId": "h", "links": [{"text": "a", "href": "b"}], "activations": [{"activationId": "a", "startsAt": {"messageId": "e", "endpoint": "target"}, "endsAt": {"messageId": "f", "endpoint": "source"}}]},
                {"nodeId": "m", "type": "fragment", "title": "M", "branches": [{"branchId": "b", "label": "l", "startMessageId": "e", "endMessageId": "f"}, {"branchId": "c", "startMessageId": "f", "endMessageId": "f"}]},
            ],
            "edges": [
                {"edgeId": "e", "type": "message", "sourceNodeId": "n", "targetNodeId": "m", "label": "l", "href": "source:///y", "messageType": "return", "activeWhen": [[{"controlId": "c", "value": "x"}, {"controlId": "d", "value": "on"}], [], [{"controlId": "d", "value": "off"}]]},
                {"edgeId": "f", "type": "message", "sourceNodeId": "m", "targetNodeId": "n", "kind": "k", "activeWhen": []},
                {"edgeId": "i", "sourceNodeId": "m", "targetNodeId": "n", "activeWhen": [[]]},
            ],
            "layoutContext": {
                "rootNodeIds": ["n", "m"],
                "controls": [{"controlId": "c", "type": "branch", "ownerNodeId": "n", "label": "C", "polarityPair": True, "cases": [{"caseId": "x", "label": "X"}, {"caseId": "y", "label": "Y"}]}, {"controlId": "d", "type": "conditional", "ownerNodeId": "m", "label": "D", "dependsOn": [[{"controlId": "c", "value": "x"}], []]}],
                "auxiliaryDefinitions": [{"definitionId": "z", "title": "Z"}],
            },
        },
    },
}


def test_round_trip(spark):
    """Written back, documents are what they were, and so is every table."""
    texts = spark.createDataFrame([("s", "full.json", json.dumps(FULL)), ("s", "plain.json", document()), ("t", "plain.json", document())], "scope_id string, artifact_id string, raw string")
    parsed = A.parse_artifacts(texts)
    assert parsed.filter("error IS NOT NULL").count() == 0
    tables = A.explode_graph(parsed)
    again = A.parse_artifacts(A.documents_of(tables, A.envelopes_of(parsed)))
    raw = {(r["scope_id"], r["artifact_id"]): json.loads(r["raw"]) for r in again.collect()}
    assert raw["s", "full.json"] == FULL
    for name, table in A.explode_graph(again).items():
        assert sorted(map(repr, table.collect())) == sorted(map(repr, tables[name].collect())), name
