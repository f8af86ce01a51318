"""Whitening of embeddings from a covariance that is weighted by multiplicity.

Entries become whole numbers, and rows with equal vectors are grouped with their
number. Sums are exact; the covariance is a product of centred matrices, weighted
by the number of copies or by one, formed block by block in the tasks and added
up by rows of the matrix. Only the covariance, whose size is that of a vector
squared, comes to the driver. Every different vector is whitened once, and the
result is joined back to the rows.

Defined cases: a row whose vector is null or holds a null or non-finite entry is
left out; a null or repeated id is a value like any other; the space is that of
the most frequent length, of equal ones the longest, and a row with a vector of
another length has null results; a vector without entries has no components; a
component without variance is left out, as nothing can be scaled to one there; a
deviation beyond a long is null; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import written

SCALE = 256
COMPONENTS = 4
# Vectors with more copies than the larger of these are joined by broadcast, so
# there are at most HOT_PARTS of them, and no task of the other join gets more.
HOT_COPIES, HOT_PARTS = 10_000, 1000
# Below this share of the trace an eigenvalue is rounding.
LEAST_SHARE = 1e-12
_LARGEST = 2**63 - 1


@dataclass
class Whitening:
    """Sums and components of the vectors that were fitted."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n * x - sums) ** 2``, exact; null beyond a long."""
        bound = self.n * _largest(x) + max(map(abs, self.sums), default=0)
        whole = x if bound <= isqrt(_LARGEST // max(1, x.shape[1])) else x.astype(object)
        found = ((whole * self.n - np.array(self.sums, whole.dtype)) ** 2).sum(axis=1).tolist()
        return [v if v <= _LARGEST else None for v in found]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors on the components, over the root of their variance."""
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def whole_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of rows with a whole finite vector; ``x`` is ``floor(scale * entry)``."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    kept = rows.where(F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(finite(c), F.lit(False))))
    return kept.select("vec_id", F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("x"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``x, copies`` of every different vector; equal ones meet in the tasks before they are dealt out."""
    return rows.groupBy("x").agg(F.count("*").alias("copies"))


def _largest(x: np.ndarray) -> int:
    return max(1, int(x.max(initial=0)), -int(x.min(initial=0)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def vector_sums(vectors: DataFrame, weight: str, size: int) -> tuple[int, list[int]]:
    """Sum of the weights and of the weighted entries of each dimension, exact."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            x, w = _matrix(batch.column(0), size), np.asarray(batch.column(1))
            n += int(w.sum())
            if _largest(x) * int(w.sum()) > _LARGEST:
                x = x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, w @ x)]
        if n:
            totals = pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int64()), totals, pa.array([n] * size, pa.int64())], names=["i", "s", "n"])

    partial = vectors.select("x", weight).mapInArrow(add_up, "i bigint, s decimal(38,0), n bigint")
    found = partial.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # one row per dimension
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in sorted(found, key=lambda r: r["i"])]


def covariance(vectors: DataFrame, weight: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Weighted covariance with divisor ``n``: centred blocks are multiplied, products added up by rows."""
    size = len(mean)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            centred = _matrix(batch.column(0), size) - mean
            product = (centred * np.asarray(batch.column(1))[:, None]).T @ centred
            total = product if total is None else total + product
        if total is None:
            return
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    products = vectors.select("x", weight).mapInArrow(multiply, "i bigint, row array<double>")
    cells = products.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row"))
    found = {r["i"]: r["row"] for r in rows.collect()}  # one matrix of the size of a vector squared
    matrix = np.array([found[i] for i in range(size)]).reshape(size, size) / n
    return (matrix + matrix.T) / 2


def fit(vectors: DataFrame, size: int, weight: str = "one", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of ``x, copies`` with vectors of ``size`` entries; ``weight`` is ``copies`` or ``one``.

    None without vectors or entries.
    """
    if weight == "one":
        vectors = vectors.withColumn("one", F.lit(1).cast("bigint"))
    n, sums = vector_sums(vectors, weight, size) if size else (0, [])
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    matrix = covariance(vectors, weight, mean, n)
    values, axes = np.linalg.eigh(matrix)
    trace = float(np.trace(matrix))
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > LEAST_SHARE * max(trace, 1e-300)]
    axes = axes[:, order]
    # The largest entry of a component is positive, so that reruns agree.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    return Whitening(n, sums, mean, values[order], axes, values[order] / trace if trace else values[order])


def whitened_vectors(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``x, copies, deviation, whitened`` of every different vector."""

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), len(model.sums))
            columns = [*batch.columns, pa.array(model.deviation(x), pa.int64())]
            columns.append(pa.array(list(model.whiten(x)), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=["x", "copies", "deviation", "whitened"])

    schema = "x array<bigint>, copies bigint, deviation bigint, whitened array<double>"
    return vectors.select("x", "copies").mapInArrow(whiten, schema)


def identity_error(whitened: DataFrame, components: int, weight: str = "one") -> float:
    """Largest entry of the covariance of the whitened vectors less the identity, absolute."""
    w = F.col("copies") if weight == "copies" else F.lit(1)
    at = lambda i: F.get("whitened", F.lit(i))
    sums = [F.sum(at(i) * w).alias(f"s{i}") for i in range(components)]
    sums += [F.sum(at(i) * at(j) * w).alias(f"p{i}_{j}") for i in range(components) for j in range(i + 1)]
    found = whitened.agg(F.sum(w).alias("n"), *sums).first()
    n = found["n"]
    entry = lambda i, j: found[f"p{i}_{j}"] / n - found[f"s{i}"] * found[f"s{j}"] / n**2 - (i == j)
    return max((abs(entry(i, j)) for i in range(components) for j in range(i + 1)), default=0.0)


def whiten(rows: DataFrame, vector: str = "embedding", weight: str = "one", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """``vec_id, deviation, whitened`` of every row, the fit, and its identity error.

    Rows come to their vector by a join on the vector. The few vectors with very
    many copies are sent to all tasks, the others are dealt out.
    """
    whole = written(whole_vectors(rows, vector), "whole-vectors")
    vectors = written(distinct_vectors(whole), "distinct-vectors")
    size = F.size("x")
    lengths = whole.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    blank = [F.lit(None).cast("bigint").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")]
    if not lengths:
        return whole.select("vec_id", *blank), None, 0.0
    dimensions = lengths[0]["size"]
    fitted = vectors.where(size == dimensions)
    model = fit(fitted, dimensions, weight, components)
    if model is None:  # vectors without entries
        return whole.select("vec_id", *blank), None, 0.0
    done = written(whitened_vectors(fitted, model), "whitened")
    error = identity_error(done, len(model.values), weight)

    hot = F.col("copies") > max(HOT_COPIES, whole.count() // HOT_PARTS)
    own = done.select(F.col("x").alias("_x"), "copies", "deviation", "whitened")
    few, many = F.broadcast(own.where(hot)), own.where(~hot)
    out = ["vec_id", "deviation", "whitened"]
    same = whole.where(size == dimensions)
    by_hot = same.join(few, F.col("x") == F.col("_x")).select(*out)
    by_rest = same.join(few, F.col("x") == F.col("_x"), "left_anti").join(many, F.col("x") == F.col("_x")).select(*out)
    return by_hot.unionByName(by_rest).unionByName(whole.where(size != dimensions).select("vec_id", *blank)), model, error
