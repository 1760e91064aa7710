"""Integrity of graphs. Each rule returns (artifact_id, path, code, message).

A path names the table, the element's ordinal in it and the field. Codes are
the rules' names. All rules are anti-joins, windows or joins over whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixpoint import settled
from .graph import in_cycles_or_before, on_pointer_cycles

ISSUE = ("artifact_id", "path", "code", "message")


def issues(df: DataFrame, path: Column | str, code: str, *message: Column | str) -> DataFrame:
    """Rows of df as issues; strings in message are texts, columns are values."""
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return df.select("artifact_id", (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(code).alias("code"), F.concat(*parts).alias("message"))


def _at(table: str, field: str, ordinal: str = "ordinal") -> Column:
    return F.concat_ws("/", F.lit(table), F.col(ordinal).cast("string"), F.lit(field))


def _repeats(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Second and later rows of a key, in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n > 1")


def duplicate_element_ids(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, rank, table, key: df.select("artifact_id", F.lit(rank).alias("rank"), F.lit(table).alias("table"), F.lit(key[1]).alias("field"), "ordinal", F.col(key[0]).alias("id"))
    every = one(groups, 0, "groups", ("group_id", "groupId")).union(one(nodes, 1, "nodes", ("node_id", "nodeId"))).union(one(edges, 2, "edges", ("edge_id", "edgeId")))
    again = _repeats(every, ["artifact_id", "id"], ["rank", "ordinal"])
    return issues(again, F.concat_ws("/", "table", F.col("ordinal").cast("string"), "field"), "duplicate_element_ids", "Duplicate diagram element ID: ", F.col("id"))


def unknown_parent_groups(groups: DataFrame) -> DataFrame:
    known = groups.select("artifact_id", F.col("group_id").alias("parent_group_id")).distinct()
    bad = groups.filter("parent_group_id <> ''").join(known, ["artifact_id", "parent_group_id"], "left_anti")
    return issues(bad, _at("groups", "parentGroupId"), "unknown_parent_groups", "Diagram group ", F.col("group_id"), " has unknown parent ", F.col("parent_group_id"))


def group_cycles(groups: DataFrame) -> DataFrame:
    """One issue for each artifact with a cycle in its hierarchy."""
    pointers = groups.select("artifact_id", F.col("group_id").alias("node_id"), F.col("parent_group_id").alias("up")).dropDuplicates(["artifact_id", "node_id"])
    return issues(on_pointer_cycles(pointers).select("artifact_id").distinct(), "groups", "group_cycles", "Diagram group hierarchy contains a cycle")


def unknown_node_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    bad = nodes.filter("group_id <> ''").join(groups.select("artifact_id", "group_id"), ["artifact_id", "group_id"], "left_anti")
    return issues(bad, _at("nodes", "groupId"), "unknown_node_groups", "Diagram node ", F.col("node_id"), " belongs to unknown group ", F.col("group_id"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = []
    for side, verb in (("source", "sources"), ("target", "targets")):
        known = nodes.select("artifact_id", F.col("node_id").alias(f"{side}_node_id")).distinct()
        bad = edges.join(known, ["artifact_id", f"{side}_node_id"], "left_anti")
        out.append(issues(bad, _at("edges", f"{side}NodeId"), "dangling_edges", "Diagram edge ", F.col("edge_id"), f" {verb} unknown node ", F.col(f"{side}_node_id")))
    return out[0].union(out[1])


def message_endpoint_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of message edges that are not lifelines; unknown nodes are none, either."""
    lifelines = nodes.filter("type = 'lifeline'")
    messages = edges.filter("type = 'message'")
    out = []
    for side in ("source", "target"):
        bad = messages.join(lifelines.select("artifact_id", F.col("node_id").alias(f"{side}_node_id")), ["artifact_id", f"{side}_node_id"], "left_anti")
        out.append(issues(bad, _at("edges", f"{side}NodeId"), "message_endpoint_types", "Message edge ", F.col("edge_id"), f" {side} must be a lifeline"))
    return out[0].union(out[1])


# Element types that each contract takes. The flowchart generator
# narrows the general layout.
CONTRACTS = {
    "general": {"groups": ("default", "bounding"), "nodes": ("default", "diamond", "lifeline", "fragment"), "edges": ("default", "control", "message")},
    "flowchart": {"groups": ("default", "bounding"), "nodes": ("default", "diamond"), "edges": ("default",)},
    "sequence": {"groups": ("default", "bounding"), "nodes": ("lifeline", "fragment"), "edges": ("message",)},
    "dependency-graph": {"groups": ("default",), "nodes": ("default",), "edges": ("default",)},
    "component-structure": {"groups": ("default",), "nodes": ("default",), "edges": ("default", "control")},
}
ELEMENT_TYPES = [(element, contract, kind) for contract, tables in CONTRACTS.items() for element, kinds in tables.items() for kind in kinds]


def element_type_contract(elements: DataFrame, artifacts: DataFrame) -> DataFrame:
    """elements (artifact_id, element, ordinal, type) against the types that the
    contract of their artifact (artifact_id, layout_id) takes; a flowchart has
    the layout id flowchart here."""
    spark = elements.sparkSession
    rules = F.broadcast(spark.createDataFrame(ELEMENT_TYPES, "element string, layout_id string, type string"))
    bad = elements.join(artifacts.select("artifact_id", "layout_id"), "artifact_id").join(rules, ["element", "layout_id", "type"], "left_anti")
    return issues(bad, F.concat_ws("/", "element", F.col("ordinal").cast("string"), F.lit("type")), "element_type_contract", "Layout ", F.col("layout_id"), " takes no ", F.col("element"), " of type ", F.col("type"))


def sequence_shape(artifacts: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graphs without nodes; sequences with groups or without a lifeline."""
    g = groups.groupBy("artifact_id").agg(F.count("*").alias("groups"))
    n = nodes.groupBy("artifact_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "lifeline").alias("lifelines"))
    a = artifacts.join(g, "artifact_id", "left").join(n, "artifact_id", "left").fillna(0, ["groups", "nodes", "lifelines"])
    seq = a.filter("layout_id = 'sequence'")
    return (
        issues(a.filter("nodes = 0"), "nodes", "sequence_shape", "A graph needs at least one node")
        .union(issues(seq.filter("groups > 0"), "groups", "sequence_shape", "Sequence layout does not support diagram groups"))
        .union(issues(seq.filter("lifelines = 0"), "nodes", "sequence_shape", "Sequence layout requires at least one lifeline"))
    )


def _ordinals(messages: DataFrame, prefix: str) -> DataFrame:
    return messages.select("artifact_id", F.col("edge_id").alias(f"{prefix}_message_id"), F.col("ordinal").alias(f"{prefix}_ordinal"), F.col("source_node_id").alias(f"{prefix}_source"), F.col("target_node_id").alias(f"{prefix}_target"))


def activation_issues(activations: DataFrame, messages: DataFrame) -> DataFrame:
    """activations (artifact_id, node_id, activation_id, ordinal, and for start
    and end _message_id and _endpoint)."""
    a = activations.join(_ordinals(messages, "start"), ["artifact_id", "start_message_id"], "left").join(_ordinals(messages, "end"), ["artifact_id", "end_message_id"], "left")
    at = F.concat_ws("/", F.lit("nodes"), "node_id", F.lit("activations"), F.col("ordinal").cast("string"))
    out = [issues(_repeats(a, ["artifact_id", "node_id", "activation_id"], ["ordinal"]), F.concat(at, F.lit("/activationId")), "activation_issues", "Duplicate activation ID: ", F.col("activation_id"))]
    for side, name in (("start", "startsAt"), ("end", "endsAt")):
        unknown = F.col(f"{side}_ordinal").isNull()
        out.append(issues(a.filter(unknown), F.concat(at, F.lit(f"/{name}/messageId")), "activation_issues", "Activation ", F.col("activation_id"), " references unknown message ", F.col(f"{side}_message_id")))
        end = F.when(F.col(f"{side}_endpoint") == "source", F.col(f"{side}_source")).otherwise(F.col(f"{side}_target"))
        out.append(issues(a.filter(~unknown & (end != F.col("node_id"))), F.concat(at, F.lit(f"/{name}")), "activation_issues", "Activation ", F.col("activation_id"), f" {name} does not belong to lifeline ", F.col("node_id")))
    out.append(issues(a.filter("start_ordinal > end_ordinal"), at, "activation_issues", "Activation ", F.col("activation_id"), " ends before it starts"))
    return reduce(DataFrame.union, out)


def fragment_branch_issues(branches: DataFrame, messages: DataFrame) -> DataFrame:
    """branches (artifact_id, fragment_id, branch_id, ordinal, start_message_id, end_message_id)."""
    b = branches.join(_ordinals(messages, "start"), ["artifact_id", "start_message_id"], "left").join(_ordinals(messages, "end"), ["artifact_id", "end_message_id"], "left")
    at = F.concat_ws("/", F.lit("nodes"), "fragment_id", F.lit("branches"), F.col("ordinal").cast("string"))
    out = [issues(_repeats(b, ["artifact_id", "fragment_id", "branch_id"], ["ordinal"]), F.concat(at, F.lit("/branchId")), "fragment_branch_issues", "Duplicate fragment branch ID: ", F.col("branch_id"))]
    for side in ("start", "end"):
        out.append(issues(b.filter(F.col(f"{side}_ordinal").isNull()), F.concat(at, F.lit(f"/{side}MessageId")), "fragment_branch_issues", "Fragment branch ", F.col("branch_id"), " references unknown message ", F.col(f"{side}_message_id")))
    out.append(issues(b.filter("start_ordinal > end_ordinal"), at, "fragment_branch_issues", "Fragment branch ", F.col("branch_id"), " ends before it starts"))
    return reduce(DataFrame.union, out)


def root_issues(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """roots (artifact_id, ordinal, node_id): unknown, or named again."""
    known = nodes.select("artifact_id", "node_id", F.lit(True).alias("known")).distinct()
    r = roots.withColumn("n", F.row_number().over(Window.partitionBy("artifact_id", "node_id").orderBy("ordinal"))).join(known, ["artifact_id", "node_id"], "left")
    bad = r.filter("known IS NULL OR n > 1")
    word = F.when(F.col("known").isNull(), "Unknown").otherwise("Duplicate")
    return issues(bad, F.concat(F.lit("layoutContext/rootNodeIds/"), F.col("ordinal").cast("string")), "root_issues", word, " component root: ", F.col("node_id"))


def control_issues(controls: DataFrame, cases: DataFrame, nodes: DataFrame) -> DataFrame:
    at = F.concat(F.lit("layoutContext/controls/"), F.col("ordinal").cast("string"))
    again = issues(_repeats(controls, ["artifact_id", "control_id"], ["ordinal"]), F.concat(at, F.lit("/controlId")), "control_issues", "Duplicate component control: ", F.col("control_id"))
    known = nodes.select("artifact_id", F.col("node_id").alias("owner_node_id")).distinct()
    lost = issues(controls.join(known, ["artifact_id", "owner_node_id"], "left_anti"), F.concat(at, F.lit("/ownerNodeId")), "control_issues", "Unknown component control owner: ", F.col("owner_node_id"))
    twice = _repeats(cases, ["artifact_id", "control_id", "case_id"], ["ordinal"])
    case = issues(twice, F.concat_ws("/", F.lit("layoutContext/controls"), "control_id", F.lit("cases"), F.col("ordinal").cast("string"), F.lit("caseId")), "control_issues", "Duplicate component control case: ", F.col("case_id"))
    return again.union(lost).union(case)


def aux_definition_duplicates(aux: DataFrame) -> DataFrame:
    return issues(_repeats(aux, ["artifact_id", "definition_id"], ["ordinal"]), F.concat(F.lit("layoutContext/auxiliaryDefinitions/"), F.col("ordinal").cast("string"), F.lit("/definitionId")), "aux_definition_duplicates", "Duplicate auxiliary definition: ", F.col("definition_id"))


def ruleset_issues(requirements: DataFrame, controls: DataFrame, cases: DataFrame) -> DataFrame:
    """requirements (artifact_id, owner, rule_ix, req_ix, control_id, value)."""
    rule = Window.partitionBy("artifact_id", "owner", "rule_ix", "control_id").orderBy("req_ix")
    r = requirements.withColumn("before", F.lag("value").over(rule))
    kinds = controls.groupBy("artifact_id", "control_id").agg(F.max_by("type", "ordinal").alias("kind"))
    # the last control of an id counts, with its cases
    r = r.join(kinds, ["artifact_id", "control_id"], "left").join(cases.select("artifact_id", "control_id", F.col("case_id").alias("value"), F.lit(True).alias("is_case")).distinct(), ["artifact_id", "control_id", "value"], "left")
    at = F.concat_ws("/", "owner", F.lit("activeWhen"), F.col("rule_ix").cast("string"), F.col("req_ix").cast("string"))
    wrong = F.when(F.col("kind") == "conditional", ~F.col("value").isin("on", "off")).otherwise(F.col("is_case").isNull())
    return (
        issues(r.filter("before <> value"), at, "ruleset_issues", "Contradictory rule for control: ", F.col("control_id"))
        .union(issues(r.filter("kind IS NULL"), F.concat(at, F.lit("/controlId")), "ruleset_issues", "Unknown component control: ", F.col("control_id")))
        .union(issues(r.filter(F.col("kind").isNotNull() & wrong), F.concat(at, F.lit("/value")), "ruleset_issues", "Invalid value for component control ", F.col("control_id"), ": ", F.col("value")))
    )


def undeclared_roots(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    targets = edges.select("artifact_id", F.col("target_node_id").alias("node_id"))
    bad = nodes.join(targets, ["artifact_id", "node_id"], "left_anti").join(roots.select("artifact_id", "node_id"), ["artifact_id", "node_id"], "left_anti")
    return issues(bad, _at("nodes", "nodeId"), "undeclared_roots", "Component node without incoming edges must be a declared root: ", F.col("node_id"))


def control_cycles(prerequisites: DataFrame) -> DataFrame:
    """prerequisites (artifact_id, control_id, req_control_id)."""
    left = in_cycles_or_before(prerequisites.select("artifact_id", F.col("control_id").alias("source_id"), F.col("req_control_id").alias("target_id")))
    return issues(left.select("artifact_id").distinct(), "layoutContext/controls", "control_cycles", "Component control prerequisites contain a cycle")


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    """(scope_id, artifact_id, n) of ids used more than once in a scope."""
    return artifacts.groupBy("scope_id", "artifact_id").agg(F.count("*").alias("n")).filter("n > 1")


def catalog_status(scopes: DataFrame, artifacts: DataFrame, found: DataFrame) -> DataFrame:
    """(scope_id, status, n_artifacts, n_issues, message): missing without files,
    invalid with any issue, else valid. Issues stay rows; the message has the
    first in order of artifact and path. found may have scope_id, where scopes
    can have artifacts of one id."""
    a = artifacts.groupBy("scope_id").agg(F.count("*").alias("n_artifacts"))
    i = found.join(artifacts.select("scope_id", "artifact_id").distinct(), ["scope_id", "artifact_id"] if "scope_id" in found.columns else "artifact_id").groupBy("scope_id").agg(F.count("*").alias("n_issues"), F.min_by("message", F.struct("artifact_id", "path", "message")).alias("message"))
    out = scopes.select("scope_id").distinct().join(a, "scope_id", "left").join(i, "scope_id", "left").fillna(0, ["n_artifacts", "n_issues"])
    return out.select("scope_id", F.when(F.col("n_artifacts") == 0, "missing").when(F.col("n_issues") > 0, "invalid").otherwise("valid").alias("status"), "n_artifacts", "n_issues", F.coalesce("message", F.lit("")).alias("message"))


def walkthrough_problems(walkthroughs: DataFrame, elements: DataFrame, artifacts: DataFrame, groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, step, problem) of walkthroughs (artifact_id) and their
    elements (artifact_id, step, type, id and, for edge-sets, source_id,
    target_id, edge_ids). An unknown artifact has step null."""
    lost = walkthroughs.join(artifacts.select("artifact_id"), "artifact_id", "left_anti").select("artifact_id", F.lit(None).cast("long").alias("step"), F.concat(F.lit("Walkthrough references an unknown artifact: "), "artifact_id").alias("problem"))
    known = elements.join(artifacts.select("artifact_id"), "artifact_id", "left_semi")
    label = lambda what, c: F.concat(F.lit("Step "), (F.col("step") + 1).cast("string"), F.lit(f": unknown diagram {what}: "), F.col(c)).alias("problem")
    ids = {"group": groups.select("artifact_id", F.col("group_id").alias("id")), "node": nodes.select("artifact_id", F.col("node_id").alias("id")), "edge": edges.select("artifact_id", F.col("edge_id").alias("id"))}
    out = [known.filter(F.col("type") == k).join(v, ["artifact_id", "id"], "left_anti").select("artifact_id", "step", label(k, "id")) for k, v in ids.items()]
    if "edge_ids" in elements.columns:
        sets = known.filter("type = 'edge-set'")
        ends = ids["group"].union(ids["node"]).distinct()
        e = sets.join(ends.select("artifact_id", F.col("id").alias("source_id"), F.lit(1).alias("s")), ["artifact_id", "source_id"], "left").join(ends.select("artifact_id", F.col("id").alias("target_id"), F.lit(1).alias("t")), ["artifact_id", "target_id"], "left")
        text = F.concat(F.lit("Step "), (F.col("step") + 1).cast("string"), F.lit(": edge-set endpoints must be existing groups or nodes: from "), "source_id", F.lit(" to "), "target_id").alias("problem")
        out.append(e.filter("s IS NULL OR t IS NULL").select("artifact_id", "step", text))
        out.append(sets.select("artifact_id", "step", F.explode("edge_ids").alias("id")).join(ids["edge"], ["artifact_id", "id"], "left_anti").select("artifact_id", "step", label("edge", "id")))
    return reduce(DataFrame.union, [lost, *out])


def audit_annotation_targets(annotations: DataFrame, elements: DataFrame) -> DataFrame:
    """annotations (canvas_id, annotation_id, target_type, target_id) whose
    target is no element (canvas_id, type, id) of the active catalog."""
    known = elements.select("canvas_id", F.col("type").alias("target_type"), F.col("id").alias("target_id")).distinct()
    return annotations.filter("target_id IS NOT NULL").join(known, ["canvas_id", "target_type", "target_id"], "left_anti")


def annotation_issues(annotations: DataFrame) -> DataFrame:
    """One row an annotation with its first fault: no id, no finite point, blank
    comment; null if it has none."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    fault = F.when(F.coalesce(F.length("annotation_id"), F.lit(0)) == 0, "Annotation ID must not be empty").when(~finite("x") | ~finite("y"), "Annotation point must be finite").when(F.length(F.trim(F.coalesce("body", F.lit("")))) == 0, "Comment must not be blank")
    return annotations.withColumn("fault", fault)


def unknown_fields(documents: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """documents (artifact_id, raw): keys outside the schema, for each JSON path
    of one object in `allowed`."""
    out = []
    for path, keys in allowed.items():
        found = F.json_object_keys(F.col("raw") if path == "$" else F.get_json_object("raw", path))
        bad = documents.select("artifact_id", F.explode(F.array_except(F.coalesce(found, F.array().cast("array<string>")), F.array(*map(F.lit, keys)))).alias("key"))
        out.append(issues(bad, path, "unknown_fields", "Unrecognized key: ", F.col("key")))
    return reduce(DataFrame.union, out)


#: Rules of the shared check; component structures have their own instead.
SHARED = ("duplicate_element_ids", "unknown_parent_groups", "group_cycles", "unknown_node_groups", "dangling_edges", "message_endpoint_types", "element_type_contract", "sequence_shape", "activation_issues", "fragment_branch_issues")
COMPONENT = ("element_type_contract", "root_issues", "control_issues", "aux_definition_duplicates", "ruleset_issues", "undeclared_roots", "control_cycles")


def validate_catalog(artifacts: DataFrame, *found: DataFrame) -> DataFrame:
    """The union of rules' issues, without those that do not apply to the layout
    of their artifact."""
    spark = artifacts.sparkSession
    rows = [(rule, True) for rule in COMPONENT] + [(rule, False) for rule in SHARED]
    switch = F.broadcast(spark.createDataFrame(rows, "code string, component boolean"))
    layouts = artifacts.select("artifact_id", (F.col("layout_id") == "component-structure").alias("component"))
    return reduce(DataFrame.unionByName, found).join(layouts, "artifact_id").join(switch, ["code", "component"], "left_semi").select(*ISSUE)


def _elements(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    of = lambda df, element: df.select("artifact_id", F.lit(element).alias("element"), "ordinal", "type")
    return of(groups, "groups").union(of(nodes, "nodes")).union(of(edges, "edges"))


def _owned(requirements: DataFrame, prerequisites: DataFrame) -> DataFrame:
    of_edges = requirements.select("artifact_id", F.concat(F.lit("edges/"), "edge_id").alias("owner"), "rule_ix", "req_ix", "control_id", "value")
    of_controls = prerequisites.select("artifact_id", F.concat(F.lit("layoutContext/controls/"), "control_id").alias("owner"), "rule_ix", "req_ix", F.col("req_control_id").alias("control_id"), "value")
    return of_edges.union(of_controls)


#: Each rule with the tables of a catalog (as explode_graph names them) that it takes.
RULES = {
    "duplicate_element_ids": (duplicate_element_ids, ("groups", "nodes", "edges")),
    "unknown_parent_groups": (unknown_parent_groups, ("groups",)),
    "group_cycles": (group_cycles, ("groups",)),
    "unknown_node_groups": (unknown_node_groups, ("nodes", "groups")),
    "dangling_edges": (dangling_edges, ("edges", "nodes")),
    "message_endpoint_types": (message_endpoint_types, ("edges", "nodes")),
    "element_type_contract": (lambda g, n, e, a: element_type_contract(_elements(g, n, e), a), ("groups", "nodes", "edges", "artifacts")),
    "sequence_shape": (sequence_shape, ("artifacts", "groups", "nodes")),
    "activation_issues": (lambda a, e: activation_issues(a, e.filter("type = 'message'")), ("activations", "edges")),
    "fragment_branch_issues": (lambda b, e: fragment_branch_issues(b, e.filter("type = 'message'")), ("branches", "edges")),
    "root_issues": (root_issues, ("roots", "nodes")),
    "control_issues": (control_issues, ("controls", "cases", "nodes")),
    "aux_definition_duplicates": (aux_definition_duplicates, ("aux_definitions",)),
    "ruleset_issues": (lambda r, p, c, k: ruleset_issues(_owned(r, p), c, k), ("requirements", "prerequisites", "controls", "cases")),
    "undeclared_roots": (undeclared_roots, ("nodes", "edges", "roots")),
    "control_cycles": (control_cycles, ("prerequisites",)),
}


def check_graphs(artifacts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(scope_id, artifact_id, path, code, message): all rules over the tables of
    explode_graph, those that apply to the layout of each artifact (scope_id,
    artifact_id, layout_id), and ids that a scope uses more than once.

    Scope and id together are the key of all rules, so that artifacts of one id
    in several scopes are not mixed. Rules of layouts that do not occur are
    planned, too; they find no rows.

    Each table is made once, with the kinds of its artifacts, so that a rule takes
    the rows of its layouts alone. Rules run one after the other, so that the disk
    holds the shuffles of one.
    """
    both = F.struct("scope_id", "artifact_id").alias("artifact_id")
    catalog = settled(artifacts.select(both, "layout_id").distinct())
    component = F.col("layout_id") == "component-structure"
    kinds = settled(catalog.groupBy("artifact_id").agg(F.coalesce(F.bool_or(component), F.lit(False)).alias("_component"), F.coalesce(F.bool_or(~component), F.lit(False)).alias("_shared")))
    keyed = {name: df.select(both, *(c for c in df.columns if c not in ("scope_id", "artifact_id"))) for name, df in tables.items()}
    keyed = {name: settled(df.join(kinds, "artifact_id")) for name, df in (keyed | {"artifacts": catalog}).items()}

    def taken(code: str, table: str) -> DataFrame:
        applies = {"_component": code in COMPONENT, "_shared": code in SHARED}
        return keyed[table].filter(" OR ".join(k for k, yes in applies.items() if yes)).drop(*applies)

    found = reduce(DataFrame.union, [settled(validate_catalog(catalog, rule(*(taken(code, t) for t in names)))) for code, (rule, names) in RULES.items()])
    of_graphs = found.select("artifact_id.*", "path", "code", "message")
    again = duplicate_artifacts(artifacts).withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("n"))))
    of_catalog = again.select("scope_id", "artifact_id", F.lit("artifactId").alias("path"), F.lit("duplicate_artifacts").alias("code"), F.concat(F.lit("Duplicate artifact path: "), "artifact_id").alias("message"))
    return of_graphs.union(of_catalog)
