"""Group hierarchies: ancestor paths, the peeled shell, edges rolled up to the
lowest common scope, focus, scopes and positions.

Tables are keyed by artifact_id: groups (group_id, title, parent_group_id,
synthetic), nodes (node_id, title, group_id), edges (edge_id, source_node_id,
target_node_id, kind). Every operator works on all artifacts at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixpoint import MAX_ROUNDS, settled


def group_ancestors(groups: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(artifact_id, group_id, path): the groups from the root down to this one.

    Pointers are doubled each round, so a chain of depth d takes log2(d)
    rounds. Hierarchies with a cycle do not end; check group_cycles first.
    """
    now = groups.select("artifact_id", "group_id", F.array("group_id").alias("path"), F.col("parent_group_id").alias("up"))
    for _ in range(max_rounds):
        now = settled(now)
        if now.filter("up IS NOT NULL").isEmpty():
            return now.drop("up")
        above = now.select("artifact_id", F.col("group_id").alias("up"), F.col("path").alias("head"), F.col("up").alias("next"))
        now = now.join(above, ["artifact_id", "up"], "left").select("artifact_id", "group_id", F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"), F.col("next").alias("up"))
        # 2 ** 32 levels would be a cycle
        if _ > 32:
            break
    raise RuntimeError("the group hierarchy has a cycle")


def node_ancestors(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """nodes with path, empty for ungrouped ones."""
    return nodes.join(ancestors, ["artifact_id", "group_id"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def peel_root_shell(groups: DataFrame, nodes: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """groups without wrapping shells: a sole root that is not synthetic and
    holds no node goes, and its children move up, as long as there is one. An
    artifact with an ungrouped node keeps all. Nodes stay as they are."""
    loose = nodes.filter("group_id IS NULL").select("artifact_id").distinct()
    holders = nodes.filter("group_id IS NOT NULL").select("artifact_id", "group_id").distinct()
    now = groups
    for _ in range(max_rounds):
        roots = now.filter("parent_group_id IS NULL AND NOT coalesce(synthetic, false)")
        alone = roots.groupBy("artifact_id").agg(F.min("group_id").alias("shell"), F.count("*").alias("n")).filter("n = 1")
        shells = alone.join(loose, "artifact_id", "left_anti").join(holders.withColumnRenamed("group_id", "shell"), ["artifact_id", "shell"], "left_anti").select("artifact_id", "shell")
        shells = settled(shells)
        if shells.isEmpty():
            return now
        now = now.join(shells, "artifact_id", "left").filter("shell IS NULL OR group_id <> shell")
        now = settled(now.withColumn("parent_group_id", F.expr("CASE WHEN parent_group_id = shell THEN NULL ELSE parent_group_id END")).drop("shell"))
    raise RuntimeError(f"shells left after {max_rounds} rounds")


def common_depth(a: str, b: str) -> Column:
    """How many leading groups two paths share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0)) + F.when(F.forall(same, lambda s: s), F.size(same) + 1).otherwise(0)


def lowest_common_scope(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with depth (groups in common), scope (the last of them) and, on
    each side, the child group of the scope that holds the end, if any."""
    side = lambda s: nodes.select("artifact_id", F.col("node_id").alias(f"{s}_node_id"), F.col("path").alias(f"{s}_path"))
    e = edges.join(side("source"), ["artifact_id", "source_node_id"]).join(side("target"), ["artifact_id", "target_node_id"])
    e = e.withColumn("depth", common_depth("source_path", "target_path").cast("int"))
    child = lambda s: F.try_element_at(f"{s}_path", F.col("depth") + 1).alias(f"{s}_child")
    return e.select(*edges.columns, "depth", F.when(F.col("depth") > 0, F.try_element_at("source_path", F.greatest("depth", F.lit(1)))).alias("scope"), child("source"), child("target"))


def _free_ids(wanted: DataFrame, reserved: DataFrame, prefix: str, key: list[str], name: str) -> DataFrame:
    """wanted (artifact_id, the key, base) with base as id, colons added while
    the id is reserved or taken by a base before, in order of the bases. Only
    ids that differ in colons at their end alone can meet; those are numbered by
    their colons, so no id waits for another."""
    stem, colons = lambda c: F.regexp_replace(c, ":*$", ""), lambda c: F.length(c) - F.length(F.regexp_replace(c, ":*$", ""))
    taken = reserved.filter(F.col("id").startswith(prefix)).select("artifact_id", stem("id").alias("stem"), colons("id").alias("n"))
    # of the reserved numbers r0 < r1 < ..: how many free ones lie below each
    gaps = taken.groupBy("artifact_id", "stem").agg(F.sort_array(F.collect_set("n")).alias("used"))
    gaps = gaps.select("artifact_id", "stem", "used", F.transform("used", lambda r, i: r - i).alias("gaps"))
    w = wanted.withColumns({"stem": stem("base"), "k": colons("base")}).join(gaps, ["artifact_id", "stem"], "left")
    below = F.col("k") - F.coalesce(F.size(F.filter("used", lambda r: r < F.col("k"))), F.lit(0))
    order = Window.partitionBy("artifact_id", "stem").orderBy("k")
    w = w.withColumns({"below": below, "i": F.row_number().over(order)})
    place = F.max(F.col("below") - F.col("i")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i")
    w = w.withColumn("place", place)
    number = F.col("place") + F.coalesce(F.size(F.filter("gaps", lambda g: g <= F.col("place"))), F.lit(0))
    return w.select("artifact_id", *key, F.concat("stem", F.repeat(F.lit(":"), number.cast("int"))).alias(name))


def bundle_ids(groups: DataFrame, reserved: DataFrame) -> DataFrame:
    """(artifact_id, group_id, bundle_id): bundle:<group>, with as many colons
    added as it takes to be neither a reserved id (artifact_id, id) nor that of
    another bundle."""
    return _free_ids(groups.select("artifact_id", "group_id", F.concat(F.lit("bundle:"), "group_id").alias("base")).distinct(), reserved, "bundle:", ["group_id"], "bundle_id")


def aggregate_ids(aggregates: DataFrame, reserved: DataFrame) -> DataFrame:
    """(artifact_id, source_id, target_id, aggregate_id) of aggregates: the ends as
    a JSON array after aggregate:, with colons added while that is a reserved id."""
    base = F.concat(F.lit("aggregate:"), F.to_json(F.array("source_id", "target_id")))
    ends = aggregates.select("artifact_id", "source_id", "target_id").distinct()
    return _free_ids(ends.withColumn("base", base), reserved, "aggregate:", ["source_id", "target_id"], "aggregate_id")


def reserved_ids(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = [groups.select("artifact_id", F.col("group_id").alias("id")), nodes.select("artifact_id", F.col("node_id").alias("id")), edges.select("artifact_id", F.col("edge_id").alias("id"))]
    return ids[0].union(ids[1]).union(ids[2])


def overview_members(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, edge_id, source_id, target_id, original): what each edge is
    shown as in the overview of the peeled hierarchy. Edges within the bundle of
    one group's nodes are not shown; edges of artifacts without groups are
    originals. One row an edge: members are never gathered into one value."""
    # read for ids and for ends
    return _shown(groups, nodes, settled(edges.select("artifact_id", "edge_id", "source_node_id", "target_node_id")))


def _shown(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """overview_members of edges that are made."""
    peeled = peel_root_shell(groups, nodes)
    # nodes of a peeled shell do not exist, so their groups are as before
    ancestors = group_ancestors(peeled)
    scoped = lowest_common_scope(edges, node_ancestors(nodes, ancestors))
    bundles = bundle_ids(peeled, reserved_ids(groups, nodes, edges)).select("artifact_id", F.col("group_id").alias("scope"), "bundle_id")
    e = scoped.join(bundles, ["artifact_id", "scope"], "left").join(groups.select("artifact_id", F.lit(True).alias("grouped")).distinct(), "artifact_id", "left")
    end = lambda s: F.coalesce(F.col(f"{s}_child"), F.when(F.col("scope").isNotNull(), F.col("bundle_id")).otherwise(F.col(f"{s}_node_id")))
    plain = F.col("grouped").isNull()
    e = e.withColumns({"source_id": F.when(plain, F.col("source_node_id")).otherwise(end("source")), "target_id": F.when(plain, F.col("target_node_id")).otherwise(end("target")), "original": plain})
    return e.filter(F.col("original") | (F.col("source_id") != F.col("target_id"))).select("artifact_id", "edge_id", "source_id", "target_id", "original")


def overview_aggregates(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The overview's edges with their members, a row for each member:
    (artifact_id, aggregate_id, source_id, target_id, n_edges, first_edge_id,
    edge_id, original). An aggregate is what one pair of shown ends has, with an
    id that no element has. An original stands for itself and has no such id."""
    edges = settled(edges.select("artifact_id", "edge_id", "source_node_id", "target_node_id"))
    members = settled(_shown(groups, nodes, edges))
    ends = ["artifact_id", "source_id", "target_id"]
    sized = settled(members.filter("NOT original").groupBy(*ends).agg(F.count("*").alias("n_edges"), F.min("edge_id").alias("first_edge_id")))
    told = settled(sized.join(aggregate_ids(sized, reserved_ids(groups, nodes, edges)), ends))
    shown = members.filter("NOT original").join(told, ends)
    alone = members.filter("original").select("*", F.lit(1).cast("long").alias("n_edges"), F.col("edge_id").alias("first_edge_id"), F.lit(None).cast("string").alias("aggregate_id"))
    return shown.unionByName(alone).select("artifact_id", "aggregate_id", "source_id", "target_id", "n_edges", "first_edge_id", "edge_id", "original")


def focus_node(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges at the focused nodes (artifact_id, node_id), either end."""
    return incident_edges(edges).join(focus, ["artifact_id", "node_id"], "left_semi").select("artifact_id", "edge_id").distinct()


def focus_edges(members: DataFrame, focus: DataFrame) -> DataFrame:
    """The original edges of focused aggregates (artifact_id, source_id, target_id)."""
    return members.join(focus, ["artifact_id", "source_id", "target_id"], "left_semi").select("artifact_id", "edge_id")


def incident_edges(edges: DataFrame) -> DataFrame:
    """(artifact_id, node_id, edge_id), one row for each end."""
    return edges.select("artifact_id", F.explode(F.array_distinct(F.array("source_node_id", "target_node_id"))).alias("node_id"), "edge_id")


def focus_group(groups: DataFrame, nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> DataFrame:
    """(artifact_id, focus_id, source_id, target_id, edge_id, original) for the
    focused groups (artifact_id, focus_id): inner edges as they are, crossing
    ones from or to the group. The other end is a sibling node itself, or else
    its own group, or itself if it has none."""
    paths = node_ancestors(nodes, group_ancestors(groups))
    parents = groups.select("artifact_id", F.col("group_id").alias("focus_id"), F.col("parent_group_id").alias("focus_parent"))
    inside = paths.select("artifact_id", "node_id", F.explode("path").alias("focus_id")).join(focus, ["artifact_id", "focus_id"], "left_semi")
    # a node has the focused groups above it, at most its depth, so edges are joined by their ends only
    above = inside.groupBy("artifact_id", "node_id").agg(F.collect_set("focus_id").alias("focused"))
    told = settled(nodes.select("artifact_id", "node_id", "group_id").join(above, ["artifact_id", "node_id"], "left"))
    e = edges.select("artifact_id", "edge_id", "source_node_id", "target_node_id")
    for s in ("source", "target"):
        own = told.select("artifact_id", F.col("node_id").alias(f"{s}_node_id"), F.col("group_id").alias(f"{s}_group"), F.coalesce("focused", F.array().cast("array<string>")).alias(f"{s}_focused"))
        e = e.join(own, ["artifact_id", f"{s}_node_id"])
    e = e.withColumn("focus_id", F.explode(F.array_union("source_focused", "target_focused"))).join(parents, ["artifact_id", "focus_id"])
    e = e.withColumns({f"{s}_in": F.array_contains(f"{s}_focused", F.col("focus_id")) for s in ("source", "target")})
    both = F.col("source_in") & F.col("target_in")
    end = lambda s: F.when(both, F.col(f"{s}_node_id")).when(F.col(f"{s}_in"), F.col("focus_id")).when(F.col(f"{s}_group").eqNullSafe(F.col("focus_parent")), F.col(f"{s}_node_id")).otherwise(F.coalesce(f"{s}_group", f"{s}_node_id"))
    return e.select("artifact_id", "focus_id", end("source").alias("source_id"), end("target").alias("target_id"), "edge_id", both.alias("original")).filter("original OR source_id <> target_id")


def scope_connections(groups: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, scope, source_item, target_item), distinct: edges between
    the direct items of a scope, child groups or its loose nodes as one item
    (null). Edges between loose nodes of one scope have no row."""
    scoped = lowest_common_scope(edges, node_ancestors(nodes, group_ancestors(peel_root_shell(groups, nodes))))
    items = scoped.select("artifact_id", "scope", F.col("source_child").alias("source_item"), F.col("target_child").alias("target_item"))
    return items.filter(~F.col("source_item").eqNullSafe(F.col("target_item"))).distinct()


def absolute_positions(placements: DataFrame) -> DataFrame:
    """placements (artifact_id, id, parent_id, x, y relative to the parent) with
    abs_x and abs_y, summed up the chain of parents. Rounds are log2(depth)."""
    now = placements.select("artifact_id", "id", F.col("parent_id").alias("up"), F.col("x").alias("abs_x"), F.col("y").alias("abs_y"))
    for _ in range(64):
        now = settled(now)
        if now.filter("up IS NOT NULL").isEmpty():
            return now.drop("up")
        above = now.select("artifact_id", F.col("id").alias("up"), F.col("abs_x").alias("dx"), F.col("abs_y").alias("dy"), F.col("up").alias("next"))
        now = now.join(above, ["artifact_id", "up"], "left").select("artifact_id", "id", F.col("next").alias("up"), (F.col("abs_x") + F.coalesce("dx", F.lit(0))).alias("abs_x"), (F.col("abs_y") + F.coalesce("dy", F.lit(0))).alias("abs_y"))
    raise RuntimeError("the chain of parents has a cycle")


def bundle_bounds(nodes: DataFrame, groups: DataFrame, margin: float = 32.0) -> DataFrame:
    """Bounding box, with a margin, of the nodes that lie directly in a group
    that also has subgroups. nodes have x, y, width, height."""
    mixed = groups.filter("parent_group_id IS NOT NULL").select("artifact_id", F.col("parent_group_id").alias("group_id")).distinct()
    loose = nodes.join(mixed, ["artifact_id", "group_id"], "left_semi").groupBy("artifact_id", "group_id")
    box = loose.agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("width")).alias("x2"), F.max(F.col("y") + F.col("height")).alias("y2"))
    return box.select("artifact_id", "group_id", (F.col("x1") - margin).alias("x"), (F.col("y1") - margin).alias("y"), (F.col("x2") - F.col("x1") + 2 * margin).alias("width"), (F.col("y2") - F.col("y1") + 2 * margin).alias("height"))


def level_bands(items: DataFrame) -> DataFrame:
    """items (artifact_id, scope, item, component, rank) with band (dense rank
    of the level) and place within it, by the component's first item."""
    w = Window.partitionBy("artifact_id", "scope")
    first = items.withColumn("lead", F.min("item").over(Window.partitionBy("artifact_id", "scope", "component")))
    return first.withColumn("band", F.dense_rank().over(w.orderBy("rank"))).withColumn("place", F.row_number().over(Window.partitionBy("artifact_id", "scope", "rank").orderBy("lead", "item"))).drop("lead")
