"""Cycles, depth and reach in a directed graph of dependencies, and its statistics.

Edges have (from_type, to_type). Nodes get numbers in the order of a hash of
their names, so that the numbers are as good as random; every round joins and
groups whole numbers and is written to the shared folder. Strong components come
from trimming and colouring: a node has the least number that reaches it and the
least that it reaches; where both are one, the node is in that number's component,
and edges between nodes that differ in either can be in no cycle.
Depth and reach are taken on the graph of components, where no cycle is left.

A node with very many edges is split: its edges are dealt to parts, and what is
sent along them is sent to each part once.

Defined cases: edges with a null end are left out; repeated edges count once; an
edge from a node to itself is a cycle of one; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators.ordered import least_rows, with_row_number
from lodeline.session import stored

# Edges of a node that one task joins at most; a node with more is split.
HUB_EDGES = 100_000
# Trimming goes on while a round takes away this share of the edges.
TRIM_SHARE = 0.1
GOD_CLASS_DEGREE = 20
LISTED = 10


def by_merge(frame: DataFrame) -> DataFrame:
    """``frame`` for a join in which both sides are shuffled.

    The rounds are many, and a table just small enough to be broadcast would pass
    the driver in each of them.
    """
    return frame.hint("merge")


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("from_type", "to_type").dropna().distinct()


def numbered_nodes(edges: DataFrame) -> DataFrame:
    """``node, id`` of all nodes; numbers follow a hash of the name."""
    ends = F.explode(F.array("from_type", "to_type"))
    nodes = edges.select(ends.alias("node")).distinct().withColumn("_hash", F.xxhash64("node"))
    return stored(with_row_number(nodes, [F.col("_hash"), F.col("node")], "id").select("node", "id"))


def by_number(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as ``src, dst``."""
    heads = nodes.select(F.col("node").alias("from_type"), F.col("id").alias("src"))
    tails = nodes.select(F.col("node").alias("to_type"), F.col("id").alias("dst"))
    return edges.join(by_merge(heads), "from_type").join(by_merge(tails), "to_type").select("src", "dst")


def split_edges(edges: DataFrame, at: str, hub_edges: int = HUB_EDGES) -> tuple[DataFrame, DataFrame | None]:
    """Edges with the ``part`` they are dealt to at the end ``at``, and ``id, parts`` of the hubs there.

    There are at most as many hubs as the edges divided by ``hub_edges``; with
    none, the edges are as they were.
    """
    other = "dst" if at == "src" else "src"
    parts = F.ceil(F.col("n") / hub_edges).cast("int")
    hubs = edges.groupBy(F.col(at).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > hub_edges)
    hubs = stored(hubs.select("id", parts.alias("parts")))
    if hubs.isEmpty():
        return edges, None
    part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = edges.join(by_merge(hubs.withColumnRenamed("id", at)), at, "left").withColumn("part", part).drop("parts")
    return stored(dealt), hubs


def along(values: DataFrame, edges: DataFrame, hubs: DataFrame | None, at: str) -> DataFrame:
    """Rows of ``values`` (``id`` and more) sent along the edges that have their node at the end ``at``."""
    if hubs is None:
        return values.withColumnRenamed("id", at).join(by_merge(edges), at)
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    sent = values.join(by_merge(hubs), "id", "left").withColumn("part", parts).drop("parts")
    return sent.withColumnRenamed("id", at).join(by_merge(edges), [at, "part"]).drop("part")


def least_ends(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``id, before, after``: the least numbers that reach a node and that it reaches, itself included.

    Each round takes a step along the edges both ways, and takes over what the
    node that gave the number had before, so long chains take few rounds. Only
    nodes that changed send.
    """
    forward, backward = split_edges(edges, "src", hub_edges), split_edges(edges, "dst", hub_edges)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ends = nodes.select("id", F.col("id").alias("before"), F.col("id").alias("after"), F.lit(True).alias("moved_b"), F.lit(True).alias("moved_a"))
    ends = stored(ends)
    while True:
        down = along(ends.where("moved_b").select("id", "before"), *forward, "src").select(F.col("dst").alias("id"), "before", F.lit(None).cast("bigint").alias("after"))
        up = along(ends.where("moved_a").select("id", "after"), *backward, "dst").select(F.col("src").alias("id"), F.lit(None).cast("bigint").alias("before"), "after")
        sent = down.unionByName(up).groupBy("id").agg(F.min("before").alias("_b"), F.min("after").alias("_a"))
        giver_b = ends.select(F.col("id").alias("before"), F.col("before").alias("_jb"))
        giver_a = ends.select(F.col("id").alias("after"), F.col("after").alias("_ja"))
        met = ends.join(by_merge(sent), "id", "left").join(by_merge(giver_b), "before").join(by_merge(giver_a), "after")
        before, after = F.least("before", "_b", "_jb"), F.least("after", "_a", "_ja")
        ends = stored(met.select(
            "id", before.alias("before"), after.alias("after"), (before < F.col("before")).alias("moved_b"), (after < F.col("after")).alias("moved_a")
        ))
        if ends.where("moved_b or moved_a").isEmpty():
            return ends.select("id", "before", "after")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges less those of nodes that nothing points to, or that point to nothing, while it pays."""
    size = edges.count()
    while size:
        into = edges.select(F.col("dst").alias("src")).distinct()
        out = edges.select(F.col("src").alias("dst")).distinct()
        edges = stored(edges.join(by_merge(into), "src", "left_semi").join(by_merge(out), "dst", "left_semi"))
        left = edges.count()
        if left > (1 - TRIM_SHARE) * size:
            break
        size = left
    return edges


def component_numbers(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``id, component`` of all nodes in a cycle of two nodes or more; a component is one of its nodes.

    The least number of all that is left always finds its component, and numbers
    are as good as random, so what is left falls apart in few rounds.
    """
    live, found = trimmed(edges.where("src <> dst")), []
    while not live.isEmpty():
        ends = least_ends(live, hub_edges)
        found.append(ends.where("before = after").select("id", F.col("before").alias("component")))
        end = lambda name: ends.select(F.col("id").alias(name), F.struct("before", "after").alias(f"_{name}"))
        same = live.join(by_merge(end("src")), "src").join(by_merge(end("dst")), "dst").where("_src = _dst and _src.before <> _src.after")
        live = trimmed(stored(same.select("src", "dst")))
    if not found:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    every = stored(_together(found))
    # A node that is itself the least both ways is a component of one, unless others share it.
    sizes = every.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return every.join(by_merge(sizes), "component", "left_semi").select("id", "component")


class Condensed:
    """The components of a graph and the edges between them, made once for what is asked of it."""

    def __init__(self, edges: DataFrame, hub_edges: int = HUB_EDGES) -> None:
        self.hub_edges = hub_edges
        named = stored(distinct_edges(edges))
        self.nodes = numbered_nodes(named)
        self.edges = stored(by_number(named, self.nodes))
        cyclic = component_numbers(self.edges, hub_edges)
        members = self.nodes.join(by_merge(cyclic), "id", "left").withColumn("component", F.coalesce("component", "id"))
        self.members = stored(members.select("node", "id", "component"))
        of = lambda name: self.members.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"))
        between = self.edges.join(by_merge(of("src")), "src").join(by_merge(of("dst")), "dst").where("_src <> _dst")
        self.between = stored(between.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
        self.sizes = stored(self.members.groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("least")))

    def cyclic(self) -> DataFrame:
        """``component, size, least`` of components with a cycle: two nodes or more, or one that points to itself."""
        loops = self.edges.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("_loop", F.lit(True))
        return self.sizes.join(by_merge(loops), "component", "left").where("size > 1 or _loop").drop("_loop")

    def cycle_members(self) -> DataFrame:
        """``cycle, node``: nodes in a cycle, and the least name of their component."""
        cycles = self.cyclic().select("component", F.col("least").alias("cycle"))
        return self.members.join(by_merge(cycles), "component").select("cycle", "node")

    def cycles(self) -> DataFrame:
        """``cycle, members, length, path``: of the shortest cycles through the least node of a component, the least by names.

        Distances to that node are found level by level, in all components at
        once; a component is done with when its level reaches the node again.
        The path is then walked from the node, by the least name one level nearer.
        """
        cycles = stored(self.cyclic())
        inner = self.members.join(by_merge(cycles.select("component")), "component", "left_semi").select("id", "component", "node")
        of = lambda name: inner.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"), F.col("node").alias(f"{name}_node"))
        inside = stored(
            self.edges.join(by_merge(of("src")), "src").join(by_merge(of("dst")), "dst").where("_src = _dst")
            .select("src", "dst", F.col("_src").alias("component"), "dst_node")
        )
        edges = split_edges(inside, "dst", self.hub_edges)
        roots = stored(inner.join(by_merge(cycles), "component").where("node = least").select("id", "component"))
        seen = [roots.withColumn("level", F.lit(0))]
        lengths, level = [], 0
        frontier = roots.select("id", F.col("component").alias("of"))
        while not frontier.isEmpty():
            level += 1
            reached = stored(along(frontier, *edges, "dst").select(F.col("src").alias("id"), "of").distinct())
            closed = stored(reached.join(by_merge(roots), "id", "left_semi").select(F.col("of").alias("component"), F.lit(level).alias("length")))
            lengths.append(closed)
            known = _together(seen).select("id")
            frontier = stored(
                reached.join(by_merge(known), "id", "left_anti").join(by_merge(closed.select(F.col("component").alias("of"))), "of", "left_anti").select("id", "of")
            )
            seen.append(frontier.select("id", F.col("of").alias("component"), F.lit(level).alias("level")))
        if not lengths:
            return self.sizes.select(F.col("least").alias("cycle"), F.col("size").alias("members"), F.lit(0).alias("length"), F.lit("").alias("path")).limit(0)
        levels = stored(_together(seen).select(F.col("id").alias("dst"), "level"))
        found = _together(lengths)
        walks = cycles.join(by_merge(found), "component").join(by_merge(roots), "component").select(
            "component", "length", "id", F.col("least").alias("path"), "least", F.col("size").alias("members")
        )
        out, longest = [], level
        for step in range(1, longest + 1):
            walks = stored(walks)
            out.append(walks.where(F.col("length") == step).select(F.col("least").alias("cycle"), "members", "length", "path"))
            going = walks.where(F.col("length") > step)
            onward = going.select(F.col("id").alias("src"), "component", "length").join(by_merge(inside.select("src", "dst", "dst_node")), "src")
            nearer = onward.join(by_merge(levels), "dst").where(F.col("level") == F.col("length") - step)
            chosen = nearer.groupBy("component").agg(F.min(F.struct("dst_node", "dst")).alias("to"))
            walks = going.join(by_merge(chosen), "component").select(
                "component", "length", F.col("to.dst").alias("id"), F.concat("path", F.lit(" -> "), "to.dst_node").alias("path"), "least", "members"
            )
        return _together(out)

    def depths(self) -> DataFrame:
        """``node, depth``: edges of the longest way down, a cycle taken as one node.

        The graph of components is peeled from below: a component whose
        dependencies are all gone has the number of the round as its depth, and
        takes its edges away from the counts of what depends on it.
        """
        edges = split_edges(self.between, "dst", self.hub_edges)
        counts = self.between.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("open"))
        below = self.sizes.select(F.col("component").alias("id")).join(by_merge(counts), "id", "left_anti")
        open_counts, frontier, found, level = stored(counts), stored(below), [], 0
        while not frontier.isEmpty():
            found.append(frontier.select("id", F.lit(level).alias("depth")))
            less = along(frontier, *edges, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("less"))
            left = open_counts.join(by_merge(less), "id", "left").select("id", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open"))
            left = stored(left)
            frontier = left.where("open = 0").select("id")
            open_counts = left.where("open > 0")
            level += 1
        if not found:
            return self.members.select("node", F.lit(0).alias("depth")).limit(0)
        by_component = _together(found).withColumnRenamed("id", "component")
        return self.members.join(by_merge(by_component), "component").select("node", "depth")

    def reach(self) -> DataFrame:
        """``node, reached``: number of other nodes that a node depends on, directly or not.

        Pairs of components are found in rounds. Each round sends only the pairs
        that the last one found one edge further, so no pair is made anew.
        """
        edges = split_edges(self.between, "src", self.hub_edges)
        new = self.between.select("src", F.col("dst").alias("id"))
        seen = [new]
        while not new.isEmpty():
            onward = along(new.withColumnRenamed("src", "origin"), *edges, "src").select(F.col("origin").alias("src"), F.col("dst").alias("id"))
            new = stored(onward.distinct().join(by_merge(_together(seen)), ["src", "id"], "left_anti"))
            seen.append(new)
        sizes = self.sizes.select(F.col("component").alias("id"), "size")
        sums = _together(seen).join(by_merge(sizes), "id").groupBy(F.col("src").alias("component")).agg(F.sum("size").alias("below"))
        own = self.members.join(by_merge(self.sizes.select("component", "size")), "component").join(by_merge(sums), "component", "left")
        return own.select("node", (F.coalesce("below", F.lit(0)) + F.col("size") - 1).alias("reached"))


def _together(frames: list[DataFrame]) -> DataFrame:
    every = frames[0]
    for more in frames[1:]:
        every = every.unionByName(more)
    return every


def degrees(edges: DataFrame) -> DataFrame:
    """``node, dependencies, dependents`` over distinct edges."""
    sides = F.explode(F.array(
        F.struct(F.col("from_type").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_type").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    ))
    return distinct_edges(edges).select(sides.alias("s")).groupBy("s.node").agg(F.sum("s.o").alias("dependencies"), F.sum("s.i").alias("dependents"))


def statistics(edges: DataFrame, listed: int = LISTED, god_class_degree: int = GOD_CLASS_DEGREE) -> DataFrame:
    """``measure, name, value``: the statistics of a graph with (from_type, to_type, source).

    Totals, the mean number of dependencies of a node, edges by source, the nodes
    with the most dependents and the most dependencies (ties by name), and the
    god classes: nodes with at least ``god_class_degree`` edges.
    """
    node = stored(degrees(edges))
    value = lambda c: c.cast("double").alias("value")
    totals = node.agg(F.count("*").alias("n"), F.sum("dependencies").alias("e"))
    measures = F.explode(F.array(
        F.struct(F.lit("total_classes").alias("measure"), value(F.col("n"))),
        F.struct(F.lit("total_dependencies").alias("measure"), value(F.coalesce("e", F.lit(0)))),
        F.struct(F.lit("mean_dependencies").alias("measure"), value(F.when(F.col("n") > 0, F.col("e") / F.col("n")).otherwise(0.0))),
    ))
    none = F.lit(None).cast("string").alias("name")
    out = [totals.select(measures.alias("m")).select("m.measure", none, "m.value")]
    sources = edges.dropna(subset=["from_type", "to_type"]).groupBy(F.col("source").alias("name")).agg(F.count_distinct("from_type", "to_type").alias("n"))
    out.append(sources.select(F.lit("dependencies_by_source").alias("measure"), "name", value(F.col("n"))))
    for measure, column in (("most_depended_upon", "dependents"), ("most_dependent", "dependencies")):
        top = least_rows(node.where(F.col(column) > 0), [F.desc(column), F.asc("node")], listed)
        out.append(top.select(F.lit(measure).alias("measure"), F.col("node").alias("name"), value(F.col(column))))
    degree = F.col("dependencies") + F.col("dependents")
    out.append(node.where(degree >= god_class_degree).select(F.lit("god_class").alias("measure"), F.col("node").alias("name"), value(degree)))
    return _together(out)
