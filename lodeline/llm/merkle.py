"""Merkle manifest of a dataset: one tree per source, one tree over the sources.

A leaf is the hash of a document. Leaves of a source stand in the order of their
ids; every ``FAN`` consecutive nodes become one, until one is left, the subroot.
Subroots, in the order of their sources, become the root likewise. The trees are
built a block of levels at a time, from blocks of consecutive nodes of fixed size.

Proofs come by pointer jumping. Every node holds the siblings of its first step
and points to its parent. A self-join gives each node the siblings of the node it
points to, behind its own, and that node's pointer, so the distance doubles each
round until every leaf has reached the root. Nodes that no leaf can point to any
more are left out of the next round.

Defined cases: a null is ``-`` in a leaf; a null source or id comes first; rows
with equal ids stand in the order of their leaves, equal rows in any, each a leaf
of its own; columns other than those of a leaf are not read; a source of one
document has its leaf as subroot, a lone source its subroot as root, and the
proof of a lone document is empty; no documents have no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import before_within, written
from lodeline.operators.ordered import with_row_number
from lodeline.session import cut_lineage

FAN = 3
# Levels that are built at a time: a block of FAN ** LEVELS nodes is one group.
LEVELS = 7
# Nodes that leaves point to go to all tasks up to this many bytes, and are dealt out beyond.
SENT_BYTES = 4_000_000
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
# The tree over the sources.
TOP = -1
_RANGE_BITS = 33


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of values in a row, each ``-`` if null, else its bytes in UTF-8, ``:`` and the value."""
    value = lambda c: F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    return F.sha2(F.concat(*[F.coalesce(value(c), F.lit("-")) for c in columns]), 256)


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def _hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def ordered_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tree, pos, n`` added to leaves with ``source, doc_id, leaf`` and more, and the trees.

    Equal rows are counted before they are sorted by range, and made again after
    they have their places, so none of them can fill a range. A tree is the place
    of its source among the sources.
    """
    counted = leaves.groupBy(*leaves.columns).agg(F.count("*").alias("_copies"))
    rest = [F.col(c) for c in leaves.columns if c not in ("source", "doc_id", "leaf")]
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("leaf"), *rest]
    marked = cut_lineage(counted.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    ranged = marked.withColumn("_range", F.shiftright("_id", _RANGE_BITS))
    started = before_within(ranged, [], "_range", "_copies", [F.col("_id")], "_start")
    sources = started.groupBy("source").agg(F.min("_start").alias("_first"), F.sum("_copies").alias("n"))
    trees = with_row_number(sources, [F.asc_nulls_first("source")], "tree").withColumn("tree", F.col("tree") - 1)
    trees = written(trees, "merkle-trees")
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1))
    placed = started.join(trees.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rows = placed.select(*leaves.columns, "tree", "n", (F.col("_start") - F.col("_first")).alias("_pos"), copy.alias("_copy"))
    return rows.select("tree", (F.col("_pos") + F.col("_copy")).alias("pos"), "n", *leaves.columns), trees


def build_trees(leaves: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Steps and roots of trees with ``tree, pos, n, leaf`` and columns to keep.

    ``n`` is the number of leaves of the tree, ``most`` the largest. A step is a
    node other than the root, with the hashes of its siblings to the left and to
    the right; leaves keep their columns. A root is ``tree, leaf``, the hash.
    """
    keep = [f for f in leaves.schema if f.name not in ("tree", "pos", "n", "leaf")]
    kinds = "tree bigint, level int, pos bigint, n bigint, leaf string, `left` binary, `right` binary"
    kinds += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in keep)
    names = [f.name for f in keep]

    def climber(base: int):
        def climb(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(batches).sort_by("pos")
            tree, first, n = (block.column(c)[0].as_py() for c in ("tree", "pos", "n"))
            nodes = block.column("leaf").to_pylist()
            cells = {c: [] for c in ("level", "pos", "leaf", "left", "right")}
            add = lambda *values: [cells[c].append(v) for c, v in zip(cells, values)]
            level, top = base, min(base + LEVELS, height(n))
            while level < top:
                above = []
                for start in range(0, len(nodes), FAN):
                    run = nodes[start : start + FAN]
                    above.append(_hash(run))
                    for i, node in enumerate(run):
                        sides = (bytes.fromhex("".join(part)) for part in (run[:i], run[i + 1 :]))
                        add(level, first + start + i, node, *sides)
                nodes, first, level = above, first // FAN, level + 1
            add(level, first, nodes[0], None, None)
            rows = len(cells["pos"])
            kept = block.num_rows if base == 0 else 0
            columns = [pa.array([tree] * rows, pa.int64()), pa.array(cells["level"], pa.int32()), pa.array(cells["pos"], pa.int64())]
            columns += [pa.array([n] * rows, pa.int64()), pa.array(cells["leaf"], pa.string())]
            columns += [pa.array(cells[c], pa.binary()) for c in ("left", "right")]
            for name in names:
                column = block.column(name).combine_chunks()
                blank = pa.nulls(rows - kept, column.type)
                columns.append(pa.concat_arrays([column, blank]) if kept else blank)
            made = pa.Table.from_arrays(columns, names=["tree", "level", "pos", "n", "leaf", "left", "right", *names])
            yield from made.to_batches()

        return climb

    rows, base, found = leaves, 0, []
    while True:
        size = FAN**LEVELS
        grouped = rows.withColumn("_block", F.expr(f"pos div {size}")).groupBy("tree", "_block")
        made = written(grouped.applyInArrow(climber(base), kinds), "merkle-levels")
        base, most = base + LEVELS, -(-most // size)
        found.append(made.where(F.col("left").isNotNull() | (F.col("level") < base) | (F.col("n") <= FAN**base)))
        if most <= 1:
            break
        rows = made.where(F.col("left").isNull() & (F.col("n") > FAN**base))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, every.where(F.col("left").isNull()).select("tree", "leaf")


def prove(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """Proof of every leaf, and the root.

    ``leaves`` has ``source, doc_id, leaf`` and columns to keep. The result has
    them, ``subroot`` and ``steps``: from the leaf to the root, the digests of
    the siblings to the left and to the right, as bytes one after the other.
    """
    empty = "array<struct<left: binary, right: binary>>"
    nothing = F.array().cast(empty)
    rows, trees = ordered_leaves(leaves)
    most, count = trees.agg(F.max("n"), F.count("*")).first()
    if not count:
        schema = leaves.withColumn("subroot", F.lit("")).withColumn("steps", nothing).schema
        return leaves.sparkSession.createDataFrame([], schema), None
    below, subroots = build_trees(rows.withColumn("kept", F.struct(*leaves.columns)).drop(*[c for c in leaves.columns if c != "leaf"]), most)
    tops = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(count).alias("n"), "leaf")
    above, roots = build_trees(tops, count)
    root, top_height = roots.first()["leaf"], height(count)

    # A node points to its parent; a subroot is a leaf of the tree above.
    levels = F.lit(0)
    for up in range(height(max(most, count))):
        levels = levels + (F.col("n") > FAN**up).cast("int")
    in_top, last = F.col("tree") == TOP, F.col("level") + 1 >= levels
    ends = (in_top & last) | (~in_top & last & F.lit(top_height == 0))
    point = lambda inside, over: F.when(ends, F.lit(None)).when(~in_top & last, over).otherwise(inside)
    step = F.when(F.col("left").isNotNull(), F.array(F.struct("left", "right"))).otherwise(nothing)
    nodes = below.unionByName(above, allowMissingColumns=True)
    nodes = nodes.where(F.col("left").isNotNull() | F.col("kept").isNotNull()).select(
        "tree", "level", "pos", "kept", step.cast(empty).alias("steps"),
        F.when(in_top & (F.col("level") == 0), F.col("leaf")).alias("subroot"),
        point(F.col("tree"), F.lit(TOP)).cast("bigint").alias("to_tree"),
        point(F.col("level") + 1, F.lit(0)).cast("int").alias("to_level"),
        point(F.expr(f"pos div {FAN}"), F.col("tree")).cast("bigint").alias("to_pos"),
    )
    longest, distance = max(1, height(most)) + top_height, 1
    while distance < longest:
        nodes = _jump(nodes, distance)
        distance *= 2
    proofs = nodes.where(F.col("kept").isNotNull())
    return proofs.select("kept.*", F.coalesce("subroot", F.lit(root)).alias("subroot"), "steps"), root


def _jump(nodes: DataFrame, distance: int) -> DataFrame:
    """Every node takes over the steps and the pointer of the node it points to.

    After it, nodes reach twice as far. A leaf then points to a node at least
    that high, or of the tree over the sources; no other is needed again.
    """
    met = nodes.where((F.col("tree") == TOP) | (F.col("level") >= distance)).select(
        F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("steps").alias("_steps"),
        F.col("subroot").alias("_subroot"), F.struct("to_tree", "to_level", "to_pos").alias("_next"),
    )
    if met.count() * distance * 160 <= SENT_BYTES:
        met = F.broadcast(met)
    needed = F.col("kept").isNotNull() | (F.col("tree") == TOP) | (F.col("level") >= 2 * distance)
    on = [F.col(f"to_{c}") == F.col(f"_{c}") for c in ("tree", "level", "pos")]
    joined = nodes.where(needed).join(met, on, "left").select(
        "tree", "level", "pos", "kept",
        F.when(F.col("_steps").isNull(), F.col("steps")).otherwise(F.concat("steps", "_steps")).alias("steps"),
        F.coalesce("subroot", "_subroot").alias("subroot"), "_next.*",
    )
    return written(joined, "merkle-jump")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    text = lambda c: F.lower(F.hex(c))
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(text(s["left"]), at, text(s["right"])), 256))


def siblings(steps: Column) -> Column:
    """Digests of all siblings of a proof, from the leaf to the root, as hex text."""
    return F.array_join(F.transform(steps, lambda s: F.lower(F.concat(F.hex(s["left"]), F.hex(s["right"])))), "")


def manifest(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """``doc_id, source, leaf, subroot, steps`` of every document, and the root."""
    leaf = leaf_hash([F.col(c) for c in LEAF_COLUMNS])
    return prove(docs.select("source", "doc_id", leaf.alias("leaf")))
