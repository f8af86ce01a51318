"""Packing: documents into fixed-length token sequences by first-fit decreasing.

A document is its token ids and an end id. Documents longer than a sequence are
cut at whole multiples of its length, so only what is left of a document has to
find room. Groups of documents are drawn by a hash of the id and packed without
a look at each other: the largest piece first, each into the first sequence with
room. A tournament tree over the room in the sequences finds that one in
logarithmic time.

Defined cases: a null or empty text is the end id alone; rows with equal ids are
packed each for itself; columns other than ``doc_id`` and ``text`` are not read;
no documents give no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.common import texts
from lodeline.llm.tokenize import encoder

SEQUENCE_LENGTH = 2048
END_ID = 1
# Documents of a group on average, and the most pieces of a group: beyond them the
# next pieces, in the order of their ids, are a group of their own, with their ids
# or without. A piece has 8 KB of ids at most, which bounds what a task holds.
GROUP_ROWS = 2048
HELD_PIECES = 8192
# Parts of a group number their sequences inside this range.
_GROUP_BITS = 32


def token_pieces(
    docs: DataFrame, tokenizer: str, length: int = SEQUENCE_LENGTH, end_id: int = END_ID
) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids, doc_tokens``.

    ``ids`` are little-endian unsigned 32-bit integers. ``tokenizer`` is the path
    of a file of the tokenizers library on every executor.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, starts, sizes, ids, totals = [], [], [], [], []
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(texts(batch.column(1)))):
                whole = np.append(found, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(whole), length):
                    piece = whole[start : start + length]
                    doc_ids.append(doc_id)
                    starts.append(start)
                    sizes.append(len(piece))
                    ids.append(piece.tobytes())
                    totals.append(len(whole))
            columns = [pa.array(doc_ids, batch.column(0).type), *map(pa.array, (starts, sizes))]
            columns += [pa.array(ids, pa.binary()), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class RoomTree:
    """Tournament tree over the room in a row of bins; every node has the most below it."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with that much room, and the room it had; the room is taken."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        found, room = node - self.leaves, most[node]
        most[node] = room - size
        node //= 2
        while node:
            left, right = most[2 * node], most[2 * node + 1]
            larger = left if left > right else right
            if most[node] == larger:
                break
            most[node] = larger
            node //= 2
        return found, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every size, in the order given; no size is above the capacity."""
    tree = RoomTree(len(sizes), capacity)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], room = tree.place(sizes[i])
        offsets[i] = capacity - room
    return bins, offsets


def place_pieces(
    pieces: DataFrame, groups: int, length: int = SEQUENCE_LENGTH, seed: int = 42
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length``.

    Sequence ids are unique, not dense. The columns of the pieces are kept. Groups
    are dealt to as many tasks as the session shuffles to, whatever their number.
    """
    at = len(pieces.columns)
    group = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).cast("bigint")
    dealt = (
        pieces.withColumn("_group", group)
        .repartition("_group")
        .sortWithinPartitions("_group", "doc_id", "start", "length")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, now, used = 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, used
            if count:
                whole = pa.Table.from_batches(held).combine_chunks()
                bins, offsets = first_fit_decreasing(whole.column("length").to_pylist(), length)
                first = (now << _GROUP_BITS) + used
                used += max(bins) + 1
                whole = whole.select(range(at))
                whole = whole.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64()))
                yield from whole.append_column("offset", pa.array(offsets, pa.int64())).to_batches()
            held, count = [], 0

        for batch in batches:
            marks = np.asarray(batch.column(at))
            edges = np.flatnonzero(np.diff(marks)) + 1
            for start, end in zip([0, *edges], [*edges, len(marks)]):
                if start == end:
                    continue
                if marks[start] != now:
                    yield from flush()
                    now, used = int(marks[start]), 0
                held.append(batch.slice(start, end - start))
                count += int(end - start)
                if count >= HELD_PIECES:
                    yield from flush()
        yield from flush()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(pack, f"{kinds}, sequence_id bigint, offset bigint")


def group_count(docs: DataFrame, group_rows: int = GROUP_ROWS) -> int:
    return max(1, -(-docs.count() // group_rows))


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids and their places in the sequences."""
    return place_pieces(token_pieces(docs, tokenizer, length, end_id), group_count(docs), length)


def sequences(placed: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """One row per sequence: ``sequence_id, ids, n_tokens, n_padded``.

    A sequence is padded to ``length`` unless its length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("_parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("_parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"]))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padded = F.when(power, F.col("n_tokens")).otherwise(F.lit(length)).cast("bigint")
    return whole.select("sequence_id", joined.alias("ids"), "n_tokens", padded.alias("n_padded"))
