"""Graph analytics over edge tables keyed by artifact_id: reachability, strong
components, ranks, cycles. Loops run over frontiers of all artifacts at once.

Edges are (artifact_id, source_id, target_id); nodes (artifact_id, node_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixpoint import MAX_ROUNDS, closure, discard, settled


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(artifact_id, node_id): the seeds and all that they lead to."""
    # every round reads the edges, so they are made once
    out = settled(edges.select("artifact_id", F.col("source_id").alias("node_id"), "target_id").distinct())

    def step(frontier: DataFrame) -> DataFrame:
        # compressed files of few bytes can hold millions of rows, too many for each task to have them all
        return frontier.join(out.hint("merge"), ["artifact_id", "node_id"]).select("artifact_id", F.col("target_id").alias("node_id"))

    found = closure(seeds.select("artifact_id", "node_id"), step, ["artifact_id", "node_id"], 100_000)
    discard(out)
    return found


PLAIN = 4  #: every so many rounds of trimming, whole runs go instead of a layer
PATIENCE = 8  #: rounds of labels before runs are contracted


def _run_ends(pointers: DataFrame) -> DataFrame:
    """(artifact_id, node_id, end, low) of a table with at most one pointer a
    node (artifact_id, node_id, up): end is the first node without a pointer, null
    where the chain goes round; low is the smallest node passed. Pointers are
    doubled, so rounds grow with the logarithm of the longest chain."""
    now = settled(pointers.select("artifact_id", "node_id", F.col("up").alias("end"), F.col("node_id").alias("low"), F.lit(True).alias("moved")))
    n = now.groupBy("artifact_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(n.bit_length() + 1):
        above = now.select("artifact_id", F.col("node_id").alias("end"), F.col("end").alias("next"), F.col("low").alias("other"))
        now = settled(now.join(above, ["artifact_id", "end"], "left").select("artifact_id", "node_id", F.coalesce("next", "end").alias("end"), F.least("low", "other").alias("low"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            break
    return now.select("artifact_id", "node_id", F.when(~F.col("moved"), F.col("end")).alias("end"), "low")


def _without_dead_ends(edges: DataFrame, at: str, to: str, far: bool) -> DataFrame:
    """Edges (from at to to) without those to nodes with no way on; if far, also
    without those to nodes whose only way on, however long, comes to such a node."""
    if not far:
        return edges.join(edges.select("artifact_id", F.col(at).alias(to)).distinct(), ["artifact_id", to], "left_semi")
    ends = edges.select("artifact_id", F.col(to).alias("end")).distinct().join(edges.select("artifact_id", F.col(at).alias("end")), ["artifact_id", "end"], "left_anti")
    single = edges.groupBy("artifact_id", F.col(at).alias("node_id")).agg(F.count("*").alias("n"), F.min(to).alias("up")).filter("n = 1")
    runs = _run_ends(single).join(ends, ["artifact_id", "end"], "left_semi").select("artifact_id", F.col("node_id").alias(to))
    return edges.join(runs.union(ends.withColumnRenamed("end", to)), ["artifact_id", to], "left_anti")


def _peeled(edges: DataFrame, ways: tuple[tuple[str, str], ...], max_rounds: int = 100_000) -> DataFrame:
    """Distinct edges left when those to dead ends are dropped again and again."""
    now = settled(edges.select("artifact_id", "source_id", "target_id").distinct())
    n = now.count()
    for i in range(1, max_rounds):
        for at, to in ways:
            now = _without_dead_ends(now, at, to, i % PLAIN == 0)
        now = settled(now)
        if (m := now.count()) == n:
            return now
        n = m
    raise RuntimeError("trimming did not end")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that no cycle can hold for want of a way in or out."""
    return _peeled(edges.filter("source_id <> target_id"), (("source_id", "target_id"), ("target_id", "source_id")))


def _spread(edges: DataFrame, labels: DataFrame, max_rounds: int = 100_000) -> DataFrame | None:
    """Smallest label that reaches each node along edges; None if that takes
    more rounds. Only labels that changed are sent on."""
    now = moved = settled(labels)
    for _ in range(max_rounds):
        come = edges.join(moved.select("artifact_id", F.col("node_id").alias("source_id"), "label"), ["artifact_id", "source_id"]).groupBy("artifact_id", F.col("target_id").alias("node_id")).agg(F.min("label").alias("new"))
        both = settled(now.join(come, ["artifact_id", "node_id"], "left").select("artifact_id", "node_id", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        now, moved = both.drop("moved"), both.filter("moved").drop("moved")
        if moved.isEmpty():
            return now
    return None


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with each run of nodes of one way in and one way out as one edge;
    the nodes of runs (artifact_id, node_id, head, tail), where head and tail are
    the nodes beside the run; and rings of nothing but such nodes (artifact_id,
    node_id, component)."""
    one = lambda at, to, name: edges.groupBy("artifact_id", F.col(at).alias("node_id")).agg(F.count("*").alias("n"), F.min(to).alias(name)).filter("n = 1").drop("n")
    inner = settled(one("target_id", "source_id", "before").join(one("source_id", "target_id", "after"), ["artifact_id", "node_id"]))
    heads = _run_ends(inner.withColumnRenamed("before", "up"))
    tails = _run_ends(inner.withColumnRenamed("after", "up"))
    both = settled(heads.withColumnRenamed("end", "head").join(tails.select("artifact_id", "node_id", F.col("end").alias("tail")), ["artifact_id", "node_id"]))
    runs = both.filter("head IS NOT NULL").select("artifact_id", "node_id", "head", "tail")
    gone = both.select("artifact_id", "node_id")
    kept = edges.join(gone.withColumnRenamed("node_id", "source_id"), ["artifact_id", "source_id"], "left_anti").join(gone.withColumnRenamed("node_id", "target_id"), ["artifact_id", "target_id"], "left_anti")
    over = runs.filter("head <> tail").select("artifact_id", F.col("head").alias("source_id"), F.col("tail").alias("target_id"))
    return settled(kept.select("artifact_id", "source_id", "target_id").union(over).distinct()), runs, both.filter("head IS NULL").select("artifact_id", "node_id", F.col("low").alias("component"))


def strongly_connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(artifact_id, node_id, component): component is the smallest node of the
    strong component. Nodes on no cycle are their own. artifact_id can be of any
    type that can be compared, structs included.

    Each round trims, colours every node with the first one, by hash, that
    reaches it, closes the components of those roots backwards within their
    colour, and drops edges between colours. As the order is by hash, rounds are
    few on long rows of components, too. Where colours travel far, runs of single
    ways become one edge first; their nodes are of the component of both ends, if
    that is one.
    """
    every = nodes.select("artifact_id", "node_id").distinct()
    done = every.withColumn("component", F.col("node_id")).limit(0)
    left, contracted, patience = _trimmed(edges), [], PATIENCE
    for turn in range(max_rounds):
        if (n := left.count()) == 0:
            break
        ends = left.select("artifact_id", F.col("source_id").alias("node_id")).union(left.select("artifact_id", "target_id")).distinct()
        colour = _spread(left, ends.withColumn("label", F.struct(F.xxhash64("node_id", F.lit(turn)).alias("h"), F.col("node_id").alias("root"))), patience)
        if colour is None:
            left, runs, rings = _contracted(left)
            contracted.append(runs)
            done = done.unionByName(rings)
            left = _trimmed(left)
            patience = PATIENCE if left.count() < n else MAX_ROUNDS
            continue
        patience = PATIENCE
        same = settled(left.join(colour.select("artifact_id", F.col("node_id").alias("source_id"), F.col("label").alias("c")), ["artifact_id", "source_id"]).join(colour.select("artifact_id", F.col("node_id").alias("target_id"), F.col("label").alias("d")), ["artifact_id", "target_id"]).filter("c = d").select("artifact_id", "source_id", "target_id"))
        back = same.select("artifact_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
        members = reachable(back, colour.filter("node_id = label.root").select("artifact_id", "node_id"))
        # a colour has one root, and back edges stay within a colour
        found = settled(members.join(colour, ["artifact_id", "node_id"]).select("artifact_id", "node_id", F.col("label.root").alias("component")))
        done = done.unionByName(found)
        gone = found.select("artifact_id", "node_id")
        left = same.join(gone.withColumnRenamed("node_id", "source_id"), ["artifact_id", "source_id"], "left_anti").join(gone.withColumnRenamed("node_id", "target_id"), ["artifact_id", "target_id"], "left_anti")
        left = _trimmed(left)
    else:
        raise RuntimeError(f"components left after {max_rounds} rounds")
    for runs in reversed(contracted):
        end = lambda name: done.select("artifact_id", F.col("node_id").alias(name), F.col("component").alias(f"of_{name}"))  # noqa: B023, E731
        told = runs.join(end("head"), ["artifact_id", "head"], "left").join(end("tail"), ["artifact_id", "tail"], "left")
        inside = told.select("artifact_id", "node_id", F.coalesce("of_head", "head").alias("component"), F.coalesce("of_tail", "tail").alias("other")).filter("component = other").drop("other")
        done = settled(done.unionByName(inside).repartition("artifact_id", "node_id"))
    out = every.join(done, ["artifact_id", "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))
    low = out.groupBy("artifact_id", "component").agg(F.min("node_id").alias("low"))
    return out.join(low, ["artifact_id", "component"]).select("artifact_id", "node_id", F.col("low").alias("component"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges between different strong components."""
    c = components.select("artifact_id", F.col("node_id").alias("source_id"), F.col("component").alias("a"))
    d = components.select("artifact_id", F.col("node_id").alias("target_id"), F.col("component").alias("b"))
    return edges.join(c, ["artifact_id", "source_id"]).join(d, ["artifact_id", "target_id"]).filter("a <> b").select("artifact_id", F.col("a").alias("source_id"), F.col("b").alias("target_id")).distinct()


def longest_paths(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(artifact_id, node_id, rank): edges on the longest way into each node of
    an acyclic graph.

    Ways are doubled: a node's best known way is prolonged by its first node's
    best, so ranks settle in few rounds on long chains, too.
    """
    # Bellman-Ford on max-plus with doubling of single-predecessor chains
    into = edges.groupBy("artifact_id", "target_id").agg(F.count("*").alias("n"), F.min("source_id").alias("only"))
    chain = into.filter("n = 1").select("artifact_id", F.col("target_id").alias("node_id"), F.col("only").alias("up"))
    all_nodes = nodes.select("artifact_id", "node_id").distinct()
    # jump: the first node above a run of single predecessors, and how far it is
    jump = settled(all_nodes.join(chain, ["artifact_id", "node_id"], "left").select("artifact_id", "node_id", F.coalesce("up", "node_id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("far")))
    for _ in range(64):
        above = jump.select("artifact_id", F.col("node_id").alias("top"), F.col("top").alias("next"), F.col("far").alias("more"))
        longer = settled(jump.join(above, ["artifact_id", "top"]).select("artifact_id", "node_id", F.col("next").alias("top"), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")))
        jump = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            break
    # what is left: edges into nodes with several predecessors, from run to run
    several = into.filter("n > 1").select("artifact_id", "target_id")
    top = jump.select("artifact_id", F.col("node_id").alias("source_id"), "top", "far")
    runs = settled(edges.join(several, ["artifact_id", "target_id"], "left_semi").join(top, ["artifact_id", "source_id"]).groupBy("artifact_id", F.col("top").alias("source_id"), "target_id").agg((F.max("far") + 1).alias("w")))
    heads = jump.filter("far = 0").select("artifact_id", "node_id").withColumn("rank", F.lit(0))
    now, frontier = settled(heads), settled(heads)
    for _ in range(max_rounds):
        come = frontier.join(runs.withColumnRenamed("source_id", "node_id"), ["artifact_id", "node_id"]).groupBy("artifact_id", F.col("target_id").alias("node_id")).agg(F.max(F.col("rank") + F.col("w")).alias("new"))
        both = settled(now.join(come, ["artifact_id", "node_id"], "left").select("artifact_id", "node_id", F.greatest("rank", F.coalesce("new", F.lit(0))).alias("rank"), (F.col("new") > F.col("rank")).alias("moved")))
        now, frontier = both.drop("moved"), both.filter("moved").drop("moved")
        if frontier.isEmpty():
            ranks = now.select("artifact_id", F.col("node_id").alias("top"), "rank")
            return jump.join(ranks, ["artifact_id", "top"]).select("artifact_id", "node_id", (F.col("rank") + F.col("far")).alias("rank"))
    raise RuntimeError("the graph has a cycle")


def dependency_rank(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(artifact_id, node_id, component, rank): the longest-path level of each
    node's strong component."""
    components = settled(strongly_connected(nodes, edges) if components is None else components)
    parts = components.select("artifact_id", F.col("component").alias("node_id")).distinct()
    ranks = longest_paths(parts, settled(condensed(edges, components)))
    return components.join(ranks.withColumnRenamed("node_id", "component"), ["artifact_id", "component"])


def source_components(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the components that no other component leads to."""
    into = condensed(edges, components).select("artifact_id", F.col("target_id").alias("component"))
    return components.join(into, ["artifact_id", "component"], "left_anti")


def single_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact_id, root): the only node that no edge targets, else null."""
    free = nodes.join(edges.select("artifact_id", F.col("target_id").alias("node_id")), ["artifact_id", "node_id"], "left_anti")
    one = free.groupBy("artifact_id").agg(F.min("node_id").alias("low"), F.countDistinct("node_id").alias("n"))
    return nodes.select("artifact_id").distinct().join(one, "artifact_id", "left").select("artifact_id", F.when(F.col("n") == 1, F.col("low")).alias("root"))


def on_pointer_cycles(pointers: DataFrame) -> DataFrame:
    """Of a table with one pointer a node (artifact_id, node_id, up), the nodes
    whose chain never ends, after doubling the pointers past any chain."""
    now = settled(pointers.select("artifact_id", "node_id", "up"))
    n = max(2, now.groupBy("artifact_id").count().agg(F.max("count")).first()[0] or 0)
    for _ in range(n.bit_length() + 1):
        above = now.select("artifact_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        now = settled(now.filter("up IS NOT NULL").join(above, ["artifact_id", "up"], "left").select("artifact_id", "node_id", F.col("next").alias("up")))
    return now.filter("up IS NOT NULL").select("artifact_id", "node_id")


def in_cycles_or_before(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without a way out are dropped again and again: those
    of cycles and of ways into cycles. None are left in acyclic artifacts. A run
    of nodes with one way out each goes at once."""
    return _peeled(edges, (("source_id", "target_id"),))


def merge_equivalent(nodes: DataFrame, edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(artifact_id, node_id, representative): partition refinement. Two nodes
    stay one class while they have the same label and the same set of (edge
    label, class of the target). nodes have label, edges have label.

    A node's set is summed up by adding hashes of its distinct members, so a
    node of any degree is never gathered into one value.
    """
    now = settled(nodes.select("artifact_id", "node_id", F.xxhash64("artifact_id", "label").alias("class")))
    classes = now.select("artifact_id", "class").distinct().count()
    for _ in range(max_rounds):
        to = now.select("artifact_id", F.col("node_id").alias("target_id"), F.col("class").alias("target_class"))
        members = edges.join(to, ["artifact_id", "target_id"]).select("artifact_id", F.col("source_id").alias("node_id"), F.xxhash64("label", "target_class").alias("h")).distinct()
        signs = members.groupBy("artifact_id", "node_id").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("k"))
        now = settled(now.join(signs, ["artifact_id", "node_id"], "left").select("artifact_id", "node_id", F.xxhash64("class", "s", "k").alias("class")))
        more = now.select("artifact_id", "class").distinct().count()
        if more == classes:
            low = now.groupBy("artifact_id", "class").agg(F.min("node_id").alias("representative"))
            return now.join(low, ["artifact_id", "class"]).select("artifact_id", "node_id", "representative")
        classes = more
    raise RuntimeError(f"classes still split after {max_rounds} rounds")
