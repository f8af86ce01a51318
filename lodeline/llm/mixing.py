"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Every source is a queue of its documents in shuffled order, passed through twice.
A document's virtual finish time is the number of words of its source up to its
own end, divided by the words the source is to give. Sorted by that time, the
queues advance side by side in the wanted shares; the mix is the start of that
order up to the total budget.

A queue is summed up in parts of bounded size, and so is the global order: equal
steps of virtual time hold about equal numbers of words, whatever the sizes of
the sources. Defined cases: a null text has no words, null sources are one
source, sizes of nothing give nothing, rows with equal ids are rows like others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeline.llm.common import before_within, n_words, part_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
SEED = 42


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: ``source, source_size, source_rank, target``.

    Sources in code-point order, null last, take the weights in turn. Sorted by
    the share at which a source is used up, those that are used up come first,
    and what they leave goes to the others by weight: one level for all of them.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("source_rank", (F.row_number().over(by_name) - 1).cast("bigint"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"_weight": weight, "_cap": F.lit(PASSES) * F.col("source_size")})
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "source_rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(everything)
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    levels = capped.withColumn("_level", left / F.sum("_weight").over(after))
    open_level = F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_weight"), "source_rank", "_level"))
    level = F.min(open_level).over(everything)["_level"]
    target = F.least(F.col("_cap").cast("double"), F.coalesce(level * F.col("_weight"), F.col("_cap").cast("double")))
    return levels.withColumn("target", target).select("source", "source_size", "source_rank", "target")


def shuffle_key(turn: int, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(turn), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def finish_times(sized: DataFrame, targets: DataFrame, parts: int, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, finish_0, finish_1`` of every document.

    A finish time is null where the source gives nothing.
    """
    known = targets.withColumnRenamed("source", "_source")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    step = 2**32 // parts
    for turn in range(PASSES):
        place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint")
        shuffled = rows.withColumn("_key", shuffle_key(turn, seed)).withColumn("_part", F.floor(place / step))
        order = [F.col("_key"), F.col("doc_id"), F.col("size")]
        summed = before_within(shuffled, ["source_rank"], "_part", "size", order, "_before")
        done = F.col("_before") + F.col("size") + turn * F.col("source_size")
        finish = F.when(F.col("target") > 0, done / F.col("target"))
        rows = summed.withColumn(f"finish_{turn}", finish).drop("_key", "_part", "_before")
    return rows.drop("source_rank")


def cut_time(timed: DataFrame, budget: float, parts: int) -> float:
    """The last finish time up to which the documents are within the budget.

    Time runs in equal steps. The words of each step are summed up, and only the
    step in which the budget ends is put in order.
    """
    both = F.explode(F.array(*[F.col(f"finish_{turn}") for turn in range(PASSES)]))
    times = timed.select("size", both.alias("finish")).where("finish is not null")
    stepped = times.withColumn("step", F.floor(F.col("finish") * parts))
    # One row per step, then one row per time of a single step.
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = stepped.groupBy("step").agg(F.sum("size").alias("words"))
    over = sums.withColumn("end", F.sum("words").over(upto)).where(F.col("end") > budget)
    last = over.agg(F.min(F.struct("step", "end", "words")).alias("last")).first()["last"]
    if last is None:
        return math.inf
    upto = Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0)
    ends = stepped.where(F.col("step") == last["step"]).groupBy("finish").agg(F.sum("size").alias("words"))
    ends = ends.withColumn("end", F.sum("words").over(upto) + (last["end"] - last["words"]))
    exact = ends.where(F.col("end") <= budget).agg(F.max("finish")).first()[0]
    return exact if exact is not None else math.nextafter(last["step"] / parts, -math.inf)


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, finish_0, finish_1, times`` of every document."""
    sized = written(docs.select("doc_id", "source", n_words("text").alias("size")), "sizes")
    total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = part_count(total[0])
    timed = written(finish_times(sized, source_targets(sized, weights, share), parts, seed), "finish-times")
    cut = cut_time(timed, share * total[1], parts)
    within = [F.when(F.col(f"finish_{turn}") <= cut, 1).otherwise(0) for turn in range(PASSES)]
    return timed.withColumn("times", sum(within[1:], within[0]).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, in the order of their finish times.

    Documents join their times by ``doc_id``, ``source`` and size; rows equal in
    those take each other's places.
    """
    # Both sides are dealt out by one key, once, for their places and for the join.
    key = F.xxhash64("doc_id", "source", "size").alias("_key")
    copy = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id", "source", "size"))
    times = taken(docs, weights, share, seed).where("times > 0").select("*", key).withColumn("_copy", copy)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words("text").alias("size"))
    rows = rows.select("*", key).withColumn("_copy", copy)
    same = [F.col(f"d.{c}") == F.col(f"t.{c}") for c in ("_key", "_copy")]
    finishes = F.array(*[F.col(f"t.finish_{turn}") for turn in range(PASSES)])
    joined = rows.alias("d").join(times.alias("t"), same)
    repeated = joined.select("d.row", F.explode(F.slice(finishes, F.lit(1), F.col("t.times"))).alias("finish"))
    return repeated.orderBy("finish").select("row.*")
