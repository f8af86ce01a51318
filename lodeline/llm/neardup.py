"""MinHash near-duplicates: banded signatures, links confirmed on the full sets.

A document is the set of its word shingles, and equal sets are one class. Each
class has a signature of many universal hash minima; classes that share a band
meet in a bucket. Pairs are verified on the signatures first, then on the full
sets. Not all pairs of a bucket are formed:

1. Each member meets the bucket's leader, and the links tie classes to components.
2. Buckets whose members are now one component are done. In the rest, members of
   different components meet: one by one in small buckets; in large ones the members
   outside the largest component meet all, in blocks of bounded size, of which
   only a spanning forest of the links leaves a task.

A signature keeps the low 8 bits of each minimum, which agree whenever the minima
do. Signatures refuse a pair that agrees in fewer places than a pair at the
threshold does but once in a hundred million; such a pair shares no band as
seldom. What passes is decided on the full sets, so no estimate makes a link.

Defined cases: a null text, or one without words, is an empty set and linked
with nothing; rows with equal ids are rows like others; a null id is not the
least of a component that has another. Sets are 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil, comb, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm.common import n_words, utf8, written
from lodeline.llm.components import components

SHINGLE_WORDS = 3
PERCENT = 85
BAND_ROWS = 4
MISS = 1e-8
# Buckets up to this size form pairs; larger ones are compared in blocks of up to
# so many members and shingles.
PAIRED_MEMBERS = 32
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_count(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares none with a probability below ``miss``."""
    return ceil(log(miss) / log(1 - (percent / 100) ** rows))


def agreement_bound(places: int, percent: int, miss: float = MISS) -> int:
    """Most places so that a pair at the threshold agrees in fewer with a probability below ``miss``."""
    p, below, need = percent / 100, 0.0, 0
    while need < places:
        below += comb(places, need) * p**need * (1 - p) ** (places - need)
        if below > miss:
            break
        need += 1
    return need


def agreeing(need: int):
    """Whether two columns of signatures agree in at least ``need`` places."""

    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype=bool)
        left, right = (np.frombuffer(b"".join(side), np.uint8).reshape(len(side), -1) for side in (a, b))
        return pd.Series(np.count_nonzero(left == right, axis=1) >= need)

    return F.pandas_udf(agree, "boolean")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct shingles as 64-bit hashes; a text of fewer words is one shingle."""
    found = list(map(xxhash.xxh3_64_intdigest, text.lower().split()))
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.array(found, np.uint64)
    width = min(words, len(hashes))
    with np.errstate(over="ignore"):
        rolled = np.full(len(hashes) - width + 1, len(hashes) if len(hashes) < words else words, np.uint64)
        for i in range(width):
            rolled = (rolled * _MIX) ^ hashes[i : len(hashes) - width + 1 + i]
            rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


class Signer:
    """Minima of ``a * x + b`` over the shingles, for many (a, b), as hashes of bands."""

    def __init__(self, bands: int, rows: int = BAND_ROWS, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for start in range(0, len(folded), 1024):
            values = np.multiply.outer(self.a, folded[start : start + 1024])
            values += self.b[:, None]
            np.minimum(least, values.min(axis=1), out=least)
        return least

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per band of each row of minima."""
        parts = minima.reshape(len(minima), self.bands, self.rows).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        with np.errstate(over="ignore"):
            for i in range(self.rows):
                keys = (keys ^ parts[:, :, i]) * _MIX
                keys ^= keys >> np.uint64(31)
        return keys.astype(np.int64)


def signed(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key, bands, signature`` of every document; empty sets have no key."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands)
        for batch in batches:
            sets = [shingle_set(text, words) for text in utf8(batch.column(1))]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            minima = np.array([signer.minima(s) for s in sets], np.uint32).reshape(len(sets), -1)
            keys = signer.band_keys(minima).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys))
            full = [set_key(s) if len(s) else None for s in sets]
            low = pa.array([m.astype(np.uint8).tobytes() for m in minima], pa.binary())
            columns = [batch.column(0), batch.column(2), pa.array(sizes), pa.array(full, pa.binary()), lists, low]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(sign, schema)


def text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


@contextmanager
def bloom_joins(spark: SparkSession, keys: int) -> Iterator[None]:
    """Joins run inside leave out, before they shuffle it, most of the side that has no match.

    The Bloom filter is Spark's own: it is made from a side that is a table with a
    comparison on it, has 16 bits a key and never more than 8 MB. What it lets
    through is joined like any other row, so no result depends on it.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {
        "enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t",
        "expectedNumItems": str(max(keys, 1)), "numBits": str(min(max(16 * keys, 1 << 13), 1 << 26)),
    }
    before = {name + key: spark.conf.get(name + key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(name + key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``text`` of the documents with the ids ``rep``; where hashes of ids are equal, of others too."""
    # The comparison leaves out nothing: `bloom_joins` needs one.
    ids = reps.where("n > 0").select(F.xxhash64("rep").alias("_id"))
    return docs.select(F.xxhash64("doc_id").alias("_id"), "text").join(ids, "_id", "left_semi").select("text")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``set_key, shingles`` of documents, each set once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, words) for text in utf8(batch.column(0))]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).astype(np.int64)
            columns = [pa.array([set_key(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["set_key", "shingles"])

    return docs.select("text").mapInArrow(build, "set_key binary, shingles array<bigint>")


def _linked(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


def _similar_sizes(a, b, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, need: int) -> DataFrame:
    """Those of the pairs ``u, v`` whose signatures agree and whose full sets are similar.

    Sets are joined only to the pairs that their signatures leave.
    """
    left = sets.select(F.col("set_key").alias("u"), F.col("signature").alias("_sign_u"))
    right = sets.select(F.col("set_key").alias("v"), F.col("signature").alias("_sign_v"))
    verified = pairs.select("u", "v").join(left, "u").join(right, "v").where(agreeing(need)("_sign_u", "_sign_v")).select("u", "v")
    left = sets.select(F.col("set_key").alias("u"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("set_key").alias("v"), F.col("shingles").alias("_right"))
    both = verified.join(right, "v").join(left, "u")
    inter = F.size(F.array_intersect("_left", "_right"))
    return both.where(_linked(inter, F.size("_left"), F.size("_right"), percent)).select("u", "v")


def block_links(units: DataFrame, percent: int, need: int) -> DataFrame:
    """Links between different components inside each unit of ``unit, set_key, root, signature, shingles``.

    A unit is bounded, and what leaves it is a spanning forest of its links. Sets
    whose signature agrees with none of another component go no further. The
    intersections are products of a matrix that has a row per set and a column
    per shingle held by more than one.
    """

    def met(table: pa.Table) -> np.ndarray:
        signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(table), -1)
        roots = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        same = np.zeros((len(table), len(table)), np.int16)
        for place in signs.T:
            same += place[:, None] == place[None, :]
        return ((same >= need) & (roots[:, None] != roots[None, :])).any(axis=1)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.filter(pa.array(met(table))).combine_chunks()
        if not len(table):
            return pa.table({"u": pa.array([], pa.binary()), "v": pa.array([], pa.binary())})
        keys = table.column("set_key").to_pylist()
        names: dict[bytes, int] = {}
        roots = np.array([names.setdefault(r, len(names)) for r in table.column("root").to_pylist()])
        lists = table.column("shingles").combine_chunks()
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        _, inverse, counts = np.unique(np.asarray(lists.flatten()), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(keys)), sizes)
        shared = counts[inverse] > 1
        column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
        rows = rows[shared]
        inter = np.zeros((len(keys), len(keys)), np.float32)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            low, high = np.searchsorted(column, [start, start + 2048])
            part = np.zeros((len(keys), 2048), np.float32)
            part[rows[low:high], column[low:high] - start] = 1
            inter += part @ part.T
        links = _linked(inter, sizes[:, None], sizes[None, :], percent) & (roots[:, None] != roots[None, :])
        above = list(range(len(keys)))

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        forest = []
        for i, j in zip(*np.nonzero(np.triu(links))):
            a, b = top(int(i)), top(int(j))
            if a != b:
                above[a] = b
                forest.append((keys[i], keys[j]))
        return pa.table({"u": pa.array([u for u, _ in forest], pa.binary()), "v": pa.array([v for _, v in forest], pa.binary())})

    return units.groupBy("unit").applyInArrow(compare, "u binary, v binary")


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, rows: int = BAND_ROWS
) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` of every document.

    ``component_id`` is the least id that links lead to, ``kept`` whether it is
    the document's own.
    """
    bands = band_count(percent, rows)
    need = agreement_bound(bands * rows, percent)
    light = written(signed(docs, words, bands), "signatures")
    classes = light.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    members = classes.select("set_key", "n", F.explode("bands").alias("band"))
    # Bands are counted alone (of `n`, so that both sides read the same shuffled classes),
    # and only members of buckets with others go on as a table.
    buckets = members.groupBy("band").agg(F.count("n").alias("_size")).where("_size > 1").select("band")
    met = written(members.join(buckets, "band").select("band", "set_key", "n"), "buckets")
    leaders = met.groupBy("band").agg(F.min(F.struct("set_key", "n")).alias("leader"))
    led = met.join(leaders, "band").where((F.col("set_key") != F.col("leader.set_key")) & _similar_sizes(F.col("n"), F.col("leader.n"), percent))
    pairs = led.select(F.col("set_key").alias("u"), F.col("leader.set_key").alias("v")).distinct()

    reps = written(met.select("set_key").distinct().join(classes.select("set_key", "rep", "n", "signature"), "set_key"), "reps")
    with bloom_joins(docs.sparkSession, reps.count()):
        full = full_sets(texts_of(docs, reps), words).dropDuplicates(["set_key"])
        sets = written(full.join(reps.select("set_key", "signature"), "set_key"), "sets")
    links = written(confirmed(pairs, sets, percent, need), "links")

    roots = written(components(links), "roots")
    tied = met.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    tied = tied.select("band", "set_key", "n", F.coalesce("root", "set_key").alias("root"))
    by_root = tied.groupBy("band", "root").agg(F.count("*").alias("_m"), F.sum("n").alias("_n"))
    open_ = by_root.groupBy("band").agg(
        F.sum("_m").alias("m"), F.sum("_n").alias("shingles"), F.count("*").alias("_roots"), F.max(F.struct("_m", "_n", "root")).alias("most")
    ).where("_roots > 1").drop("_roots")
    rest = written(tied.join(open_, "band"), "rest")

    small = rest.where(F.col("m") <= PAIRED_MEMBERS).select("band", "set_key", "n", "root")
    a, b = small.alias("a"), small.alias("b")
    crossing = (
        (F.col("a.band") == F.col("b.band")) & (F.col("a.set_key") < F.col("b.set_key")) & (F.col("a.root") != F.col("b.root"))
        & _similar_sizes(F.col("a.n"), F.col("b.n"), percent)
    )
    more = a.join(b, crossing).select(F.col("a.set_key").alias("u"), F.col("b.set_key").alias("v")).distinct()

    # The largest component of a bucket meets only the others, which meet all.
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK_MEMBERS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    large = rest.where(F.col("m") > PAIRED_MEMBERS).select(
        "band", "set_key", (F.col("root") == F.col("most.root")).alias("_in_most"), "root",
        blocks(F.col("m") - F.col("most._m"), F.col("shingles") - F.col("most._n")).alias("_others"),
        blocks(F.col("most._m"), F.col("most._n")).alias("_most"),
    )
    place = F.xxhash64("set_key")
    own = F.when(F.col("_in_most"), F.col("_others") + F.pmod(place, F.col("_most"))).otherwise(F.pmod(place, F.col("_others"))).cast("int")
    meets = F.col("_others") + F.when(F.col("_in_most"), 0).otherwise(F.col("_most"))
    dealt = large.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), meets - 1)))
    unit = F.struct("band", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    keys = rest.where(F.col("m") > PAIRED_MEMBERS).select("set_key")
    with bloom_joins(docs.sparkSession, keys.count()):
        dealt_sets = written(sets.join(keys, "set_key", "left_semi"), "dealt")
    units = dealt.select(unit.alias("unit"), "set_key", "root").join(dealt_sets, "set_key")

    found = confirmed(more, sets, percent, need).union(block_links(units, percent, need))
    all_links = written(links.union(found), "links")
    all_roots = written(components(all_links), "roots")

    least = light.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    rooted = least.join(all_roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    rooted = written(rooted.select("set_key", "least", F.coalesce("root", "set_key").alias("root")), "classes")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(rooted.join(ids, "root").select("set_key", "component_id"), "components")
    out = light.select("doc_id", "text_key", "n_shingles", "set_key").join(ids, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", component)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        "doc_id", "text_key", "n_shingles", "component_id", "kept"
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, and all that have no words, in the columns they came with.

    Of a group the row whose id names the component stays; of several such rows
    one with the least hash of its text.
    """
    found = near_duplicates(docs, words, percent).where("kept")
    empty = F.col("n_shingles") == 0
    chosen = found.where(~empty).groupBy("component_id").agg(F.min("text_key").alias("_key"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", text_key().alias("text_key"), n_words("text").alias("_words"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("_key"))
    once = rows.where("_words > 0").join(chosen, same).dropDuplicates(["doc_id", "text_key"])
    return once.select("_row.*").union(rows.where("_words = 0").select("_row.*"))
