"""Component graphs from facts: visibility, routes of supplied values, instances,
merged relations, conditions folded into controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixpoint import MAX_ROUNDS, closure, settled
from ..functions.exprs import glob_regex, hashed_id, to_definition_id
from .graph import reachable
from .rulesets import rulesets_of


def component_visibility(definitions: DataFrame, rules: list[str]) -> DataFrame:
    """definitions (definition_id, title, path) with visible: what the last glob
    that matches the id, the title or the path says, ! hiding. Where no rule
    includes, all begin as visible."""
    out = F.lit(all(r.startswith("!") for r in rules))
    for rule in rules:
        pattern = glob_regex(rule.removeprefix("!"))
        hit = F.lit(False)
        for c in ("definition_id", "title", "path"):
            hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
        out = F.when(hit, not rule.startswith("!")).otherwise(out)
    return definitions.withColumn("visible", out)


def consumer_routes(supplied: DataFrame, rules: DataFrame, analyzed: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Ends of supplied values: (value_id, component, prop, and value_kind if
    supplied has it).

    supplied (value_id, component, prop, and value_kind if kinds are told apart);
    rules (component, prop, kind, to_component, to_prop, excluded array): kind
    render or forward; a forward of prop '*' takes all props that it does not
    exclude, under their names; a render rule with value_kind ends values of that
    kind alone. A value does not pass a component and prop twice.

    A value ends as well at a component outside analyzed (component; where not
    given, those with a rule), unless it is a render-prop under the name of an
    event as onClick: such values are dropped there.
    """
    told = "value_kind" in supplied.columns
    values = supplied.select("value_id", "component", "prop", (F.col("value_kind") if told else F.lit("")).alias("value_kind"))
    # every round reads the rules, so they are made once
    known = settled((rules if analyzed is None else analyzed).select("component").distinct())
    rules = settled(rules.join(known, "component", "left_semi"))
    exact = settled(rules.filter("prop <> '*' AND kind = 'forward'").select("component", "prop", "to_component", "to_prop").distinct())
    spread = settled(rules.filter("prop = '*' AND kind = 'forward'").select("component", "to_component", F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded")))

    def step(f: DataFrame) -> DataFrame:
        to = F.col("to_component").alias("component")
        one = f.join(exact, ["component", "prop"]).select("value_id", to, F.col("to_prop").alias("prop"), "value_kind")
        # the concat makes prop a new attribute, without which Spark's union fails on its constraints
        more = f.join(spread, "component").filter(~F.array_contains("excluded", F.col("prop"))).select("value_id", to, F.concat("prop", F.lit("")).alias("prop"), "value_kind")
        return one.union(more)

    seen = closure(values, step, ["value_id", "component", "prop", "value_kind"], max_rounds)
    ends = rules.filter("kind = 'render'").select(F.col("component").alias("at"), F.col("prop").alias("as"), (F.col("value_kind") if "value_kind" in rules.columns else F.lit(None).cast("string")).alias("of")).distinct()
    rendered = seen.join(ends, (F.col("component") == F.col("at")) & (F.col("prop") == F.col("as")) & (F.col("of").isNull() | (F.col("of") == F.col("value_kind"))), "left_semi")
    event = (F.col("value_kind") == "render-prop") & F.col("prop").rlike("^on[A-Z]")
    outside = seen.join(known, "component", "left_anti").filter(~event)
    return rendered.unionByName(outside).select("value_id", "component", "prop", *(["value_kind"] if told else []))


def expand_instances(uses: DataFrame, roots: DataFrame, max_depth: int = MAX_ROUNDS) -> DataFrame:
    """Context instances (instance_id, definition_id, parent_id, depth, closed, and
    way if uses have ordinal: the ordinals on the way to it) of uses (use_id,
    parent_definition, definition_id) below roots (definition_id). An instance
    whose definition stands above it is closed: it is not expanded. Ids are the
    definition and a digest of the way to it."""
    ordered = "ordinal" in uses.columns
    now = roots.select(F.col("definition_id").alias("instance_id"), "definition_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.array("definition_id").alias("above"), F.lit(False).alias("closed"), F.array().cast("array<bigint>").alias("way"))
    u = uses.select("use_id", F.col("parent_definition").alias("d"), F.col("definition_id").alias("child"), (F.col("ordinal") if ordered else F.lit(0)).cast("bigint").alias("ordinal"))
    out = now = settled(now)
    for _ in range(max_depth):
        open_ = now.filter("NOT closed")
        below = open_.join(u, F.col("definition_id") == F.col("d")).select(F.concat("child", F.lit("@"), hashed_id("instance_id", "use_id")).alias("instance_id"), F.col("child").alias("definition_id"), F.col("instance_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.concat("above", F.array("child")).alias("above"), F.array_contains("above", F.col("child")).alias("closed"), F.concat("way", F.array("ordinal")).alias("way"))
        now = settled(below)
        if now.isEmpty():
            return out.drop("above") if ordered else out.drop("above", "way")
        out = out.unionByName(now)
    raise RuntimeError(f"instances deeper than {max_depth}")


def visible_instances(instances: DataFrame, hidden: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """instances (of expand_instances, with way) without those of hidden
    definitions (definition_id): what stands below a hidden one is handed to the
    nearest visible instance above it, in order. parent_id is that instance, null
    if there is none, and ordinal the place below it.

    Pointers over hidden instances are doubled, so a chain of hidden boundaries
    takes rounds by the logarithm of its length.
    """
    told = settled(instances.join(hidden.select("definition_id", F.lit(True).alias("gone")).distinct(), "definition_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False))))
    gone = told.filter("gone").select(F.col("instance_id").alias("up"), F.col("parent_id").alias("next"))
    for _ in range(max_rounds):
        gone = settled(gone)
        open_ = gone.withColumnRenamed("up", "hop").withColumnRenamed("next", "after")
        jumped = gone.join(open_, F.col("next") == F.col("hop"), "left")
        if jumped.filter("hop IS NOT NULL").isEmpty():
            break
        gone = jumped.select("up", F.when(F.col("hop").isNotNull(), F.col("after")).otherwise(F.col("next")).alias("next"))
    else:
        raise RuntimeError(f"hidden boundaries still open after {max_rounds} rounds")
    # an instance is joined by its parent only, so it is dealt out once before places are told
    kept = told.filter("NOT gone").withColumnRenamed("parent_id", "up").join(gone.withColumn("over", F.lit(True)), "up", "left")
    kept = kept.withColumn("parent_id", F.when(F.col("over"), F.col("next")).otherwise(F.col("up"))).drop("gone", "up", "next", "over")
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy("parent_id").orderBy("way", "instance_id")) - 1)


def merge_relationships(relations: DataFrame) -> DataFrame:
    """One row for each (source, target, kind, slot): rules (distinct), suppliers
    and the number of relations. relations has rule, the text of one rule, and
    supplier. An empty rule absorbs the others."""
    g = relations.groupBy("source", "target", "kind", "slot").agg(F.sort_array(F.collect_set("rule")).alias("rules"), F.sort_array(F.collect_set("supplier")).alias("suppliers"), F.count("*").alias("n"))
    return g.withColumn("rules", F.when(F.array_contains("rules", ""), F.array(F.lit(""))).otherwise(F.col("rules")))


def assemble_component_graph(edges: DataFrame, local: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): ends of edges (artifact_id, edge_id, source_id, target_id,
    slot) as local, boundary (known but not analysed) or external nodes with
    their number of origins; edges with both ends present."""
    ends = edges.select("artifact_id", F.col("target_id").alias("node_id"), F.concat_ws(":", "source_id", "slot").alias("origin"))
    n = ends.groupBy("artifact_id", "node_id").agg(F.count_distinct("origin").alias("n_origins"))
    ids = edges.select("artifact_id", F.explode(F.array("source_id", "target_id")).alias("node_id")).union(local.select("artifact_id", "node_id")).distinct()
    nodes = ids.join(local.select("artifact_id", "node_id", F.lit(1).alias("l")).distinct(), ["artifact_id", "node_id"], "left").join(known.select("artifact_id", "node_id", F.lit(1).alias("k")).distinct(), ["artifact_id", "node_id"], "left").join(n, ["artifact_id", "node_id"], "left")
    nodes = nodes.select("artifact_id", "node_id", F.when(F.col("l") == 1, "local").when(F.col("k") == 1, "boundary").otherwise("external").alias("place"), F.coalesce("n_origins", F.lit(0)).alias("n_origins"))
    have = nodes.select("artifact_id", "node_id")
    kept = edges.join(have.withColumnRenamed("node_id", "source_id"), ["artifact_id", "source_id"], "left_semi").join(have.withColumnRenamed("node_id", "target_id"), ["artifact_id", "target_id"], "left_semi")
    return nodes, kept


def focus_on_roots(nodes: DataFrame, edges: DataFrame, globs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes that match a glob by id, definition or title, all they reach, and
    the edges among these."""
    hit = F.lit(False)
    for g in globs:
        for c in (F.col("node_id"), to_definition_id("node_id"), F.col("title")):
            hit = hit | F.coalesce(c.rlike(glob_regex(g)), F.lit(False))
    links = edges.select("artifact_id", F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id"))
    kept = settled(reachable(links, nodes.filter(hit).select("artifact_id", "node_id")))
    inner = edges.join(kept.withColumnRenamed("node_id", "source_node_id"), ["artifact_id", "source_node_id"], "left_semi").join(kept.withColumnRenamed("node_id", "target_node_id"), ["artifact_id", "target_node_id"], "left_semi")
    return nodes.join(kept, ["artifact_id", "node_id"], "left_semi"), inner


def to_stored_graph(edges: DataFrame, requirements: DataFrame, suppliers: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with type and active_when, auxiliary definitions): an edge whose
    rules hold always (no requirements) is default, else control with its ruleset;
    suppliers (artifact_id, definition_id, title) without a node become auxiliary
    definitions, under their id where no title is known."""
    # dealt out by edge, so that rules and sets of them shuffle no more
    rulesets = rulesets_of(requirements.repartition("artifact_id", "edge_id"), "artifact_id", "edge_id").withColumnRenamed("ruleset", "active_when")
    typed = edges.join(rulesets, ["artifact_id", "edge_id"], "left").withColumn("type", F.when(F.col("active_when").isNotNull(), "control").otherwise("default"))
    have = nodes.select("artifact_id", to_definition_id("node_id").alias("definition_id"))
    auxiliary = suppliers.join(have, ["artifact_id", "definition_id"], "left_anti").groupBy("artifact_id", "definition_id").agg(F.coalesce(F.min("title"), "definition_id").alias("title"))
    return typed, auxiliary


def fold_polarity_controls(conditions: DataFrame) -> DataFrame:
    """conditions (control_id, owner, subject, inverted) folded by owner and
    subject: (owner, subject, type, on_control, off_control, n). Both polarities
    make a branch pair of ON and OFF, one alone a conditional."""
    first = lambda p: F.min(F.when(p, F.col("control_id")))
    g = conditions.groupBy("owner", "subject").agg(first(~F.col("inverted")).alias("on_control"), first(F.col("inverted")).alias("off_control"), F.count("*").alias("n"))
    return g.select("owner", "subject", F.when(F.col("on_control").isNotNull() & F.col("off_control").isNotNull(), "branch").otherwise("conditional").alias("type"), "on_control", "off_control", "n")


def fold_discriminants(conditions: DataFrame) -> DataFrame:
    """conditions of family equal (control_id, owner, subject, literal, inverted)
    folded by owner and subject into cases: (owner, subject, case_id, ordinal,
    n). otherwise comes last, where an inverted condition needs the rest."""
    e = conditions.filter("family = 'equal'")
    cases = e.groupBy("owner", "subject", F.col("literal").alias("case_id")).agg(F.count("*").alias("n"))
    rest = e.filter("inverted").groupBy("owner", "subject").agg(F.count("*").alias("n")).select("owner", "subject", F.lit("otherwise").alias("case_id"), "n")
    every = cases.withColumn("last", F.lit(0)).unionByName(rest.withColumn("last", F.lit(1)))
    return every.withColumn("ordinal", F.row_number().over(Window.partitionBy("owner", "subject").orderBy("last", "case_id")) - 1).drop("last")


def expanded_negations(conditions: DataFrame) -> DataFrame:
    """(control_id, case_id): the cases at which an inverted equality holds, all
    others of its owner and subject."""
    folded = fold_discriminants(conditions).select("owner", "subject", "case_id")
    e = conditions.filter("family = 'equal' AND inverted")
    return e.join(folded, ["owner", "subject"]).filter("case_id <> literal").select("control_id", "case_id")


def break_prerequisite_cycles(prerequisites: DataFrame) -> DataFrame:
    """prerequisites (artifact_id, control_id, req_control_id, creation_ix)
    without those of the control created last on a ring, as long as there is one;
    of controls created together, the larger id is the later.

    A requirement goes exactly when its control reaches itself through it by
    controls that are not later. So the earliest time at which both ends are in
    one strong component is looked for, for all requirements at once, by halving
    the span of times: those connected among the earlier half stay there, the
    others go to the later half, in which the components of the earlier one are
    single nodes. Rounds grow with the logarithm of the controls on rings.
    """
    from .graph import strongly_connected

    key = ["artifact_id", "control_id", "req_control_id"]
    links = settled(prerequisites.select(*key).distinct())
    ends = lambda df, a, b: df.select("artifact_id", F.explode(F.array(a, b)).alias("node_id")).distinct()
    of = lambda parts, a, b: parts.select("artifact_id", F.col("node_id").alias(a), F.col("component").alias(b))

    c = settled(strongly_connected(ends(links, "control_id", "req_control_id"), links.select("artifact_id", F.col("control_id").alias("source_id"), F.col("req_control_id").alias("target_id"))))
    inner = links.join(of(c, "control_id", "p"), ["artifact_id", "control_id"]).join(of(c, "req_control_id", "q"), ["artifact_id", "req_control_id"]).filter("p = q").select(*key)
    # whoever is on a ring requires something, so has a time
    made = prerequisites.groupBy("artifact_id", "control_id").agg(F.max("creation_ix").alias("creation_ix")).join(inner.select("artifact_id", "control_id"), ["artifact_id", "control_id"], "left_semi")
    times = settled(made.withColumn("time", F.row_number().over(Window.partitionBy("artifact_id").orderBy("creation_ix", "control_id"))))
    last = times.groupBy("artifact_id").agg(F.max("time").alias("hi"))
    timed = inner.join(times.select("artifact_id", "control_id", F.col("time").alias("own")), ["artifact_id", "control_id"]).join(times.select("artifact_id", F.col("control_id").alias("req_control_id"), F.col("time").alias("other")), ["artifact_id", "req_control_id"])
    now = settled(timed.join(last, "artifact_id").select(*key, "own", F.greatest("own", "other").alias("since"), F.lit(1).alias("lo"), "hi", F.col("control_id").alias("u"), F.col("req_control_id").alias("w")))
    while not now.filter("lo < hi").isEmpty():
        # where lo = hi, the row stays as it is
        half = now.withColumn("mid", F.expr("(lo + hi) div 2")).withColumn("part", F.struct("artifact_id", "lo"))
        early = half.filter("lo < hi AND since <= mid AND u <> w").select(F.col("part").alias("artifact_id"), F.col("u").alias("source_id"), F.col("w").alias("target_id"))
        c = settled(strongly_connected(ends(early, "source_id", "target_id"), early))
        part = lambda at, name: c.select(F.col("artifact_id").alias("part"), F.col("node_id").alias(at), F.col("component").alias(name))  # noqa: B023, E731
        told = half.join(part("u", "cu"), ["part", "u"], "left").join(part("w", "cw"), ["part", "w"], "left").withColumn("cu", F.coalesce("cu", "u")).withColumn("cw", F.coalesce("cw", "w"))
        stays = (F.col("lo") >= F.col("hi")) | (F.col("since") <= F.col("mid")) & (F.col("cu") == F.col("cw"))
        pick = lambda yes, no, name: F.when(stays, F.col(yes)).otherwise(no).alias(name)  # noqa: B023, E731
        now = settled(told.select(*key, "own", "since", pick("lo", F.col("mid") + 1, "lo"), pick("mid", F.col("hi"), "hi"), pick("u", F.col("cu"), "u"), pick("w", F.col("cw"), "w")).repartition("artifact_id", "control_id"))
    return prerequisites.join(now.filter("lo = own").select(*key), key, "left_anti")


def component_origins(nodes: DataFrame, origins: DataFrame, aux: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, node_id, entry), distinct: from <supplier> (<slot>) for
    origins (artifact_id, node_id, supplier_id, slot), with titles from the
    registry, then from nodes; labels of incoming edges where there are none."""
    titles = nodes.select("artifact_id", to_definition_id("node_id").alias("supplier_id"), F.col("title").alias("node_title")).dropDuplicates(["artifact_id", "supplier_id"])
    o = origins.join(aux.select("artifact_id", F.col("definition_id").alias("supplier_id"), F.col("title").alias("aux_title")), ["artifact_id", "supplier_id"], "left").join(titles, ["artifact_id", "supplier_id"], "left")
    named = o.select("artifact_id", "node_id", F.concat(F.lit("from "), F.coalesce("aux_title", "node_title", F.lit("outside graph")), F.lit(" ("), "slot", F.lit(")")).alias("entry"))
    labels = edges.filter("label <> ''").select("artifact_id", F.col("target_node_id").alias("node_id"), F.col("label").alias("entry")).join(origins.select("artifact_id", "node_id"), ["artifact_id", "node_id"], "left_anti")
    return named.union(labels).distinct()


def controls_by_owner(nodes: DataFrame, controls: DataFrame) -> DataFrame:
    """(artifact_id, node_id, n_controls, controls): those that a card's
    definition owns; every card of a definition has them."""
    own = controls.groupBy("artifact_id", F.col("owner_node_id").alias("definition_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "control_id"))), lambda c: c["control_id"]), ",").alias("controls"), F.count("*").alias("n_controls"))
    return nodes.select("artifact_id", "node_id", to_definition_id("node_id").alias("definition_id")).join(own, ["artifact_id", "definition_id"]).select("artifact_id", "node_id", "n_controls", "controls")
