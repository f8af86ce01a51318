"""Best-fit packing with swaps: documents into as few fixed-length sequences as can be.

A document is its token ids and an end id; only documents longer than a sequence
are cut, into pieces of its length. Groups of pieces are drawn by hash. In each,
pieces go by size into the fullest bin that has room. Then a local search takes
the emptiest bin and moves pieces out of it, or exchanges one or two of them for
a smaller piece of a fuller bin, or one for two smaller ones. Every step takes
from the emptier bin and gives to the fuller, so the sum of the squared fills
grows and the search ends; it ends at once where no group of bins could be fewer.

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

from lodeline.llm import packing

SEQUENCE_LENGTH = 2048
END_ID = 0
# Documents of a group on average, and the pieces of a group at most: pieces with
# one hash beyond them, in the order of their sizes, are a group of their own.
# With their ids, at most 8 KB each, these bound what a task holds.
GROUP_ROWS = 8192
HELD_PIECES = 16_384
# Bins that the search fails to empty, one after the other, before it stops.
PATIENCE = 16
_GROUP_BITS = 32


class Bins:
    """Bins of one capacity, the pieces in them, and a search that empties bins."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes = np.asarray(sizes, np.int64)
        self.capacity = capacity
        self.inside: list[list[int]] = []
        self._best_fit(sizes)
        self.fill = np.array([sum(sizes[i] for i in found) for found in self.inside], np.int64)
        self.of = np.empty(len(sizes), np.int64)
        for place, found in enumerate(self.inside):
            self.of[found] = place

    def _best_fit(self, sizes: list[int]) -> None:
        """Largest first, each piece into the fullest bin with room: bins by room, rooms as bits."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = rooms >> sizes[i]
            if fits:
                room = sizes[i] + (fits & -fits).bit_length() - 1
                place = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
                self.inside[place].append(i)
            else:
                room, place = self.capacity, len(self.inside)
                self.inside.append([i])
            left = room - sizes[i]
            by_room[left].append(place)
            rooms |= 1 << left

    @property
    def least(self) -> int:
        """No packing has fewer bins."""
        return -(-int(self.sizes.sum()) // self.capacity)

    def empty_bins(self, patience: int = PATIENCE) -> None:
        """Empty one bin after the other until none can be, or the number is the least."""
        live, stuck = int((self.fill > 0).sum()), set()
        while live > self.least and len(stuck) < min(patience, live):
            order = np.argsort(self.fill, kind="stable")
            taken = next(int(b) for b in order if self.fill[b] and int(b) not in stuck)
            while self.inside[taken] and self._improve(taken):
                pass
            if self.inside[taken]:
                stuck.add(taken)
            else:
                live -= 1
                stuck.clear()

    def _improve(self, taken: int) -> bool:
        """The step that gives most to the fuller bin: a move or an exchange of one or two for one, else of one for two."""
        room = self.capacity - self.fill
        open_bins = np.flatnonzero((room > 0) & (self.fill >= self.fill[taken]))
        open_bins = open_bins[open_bins != taken]
        if not len(open_bins):
            return False
        own = self.inside[taken]
        singles = self._sums(own, 1)
        both = {**self._sums(own, 2), **singles}
        items = np.flatnonzero(np.isin(self.of, open_bins))
        # A bin without a piece to give back is a move.
        bins = np.concatenate([open_bins, self.of[items]])
        back = np.concatenate([np.zeros(len(open_bins), np.int64), self.sizes[items]])
        best = self._best(taken, both, bins, back, room)
        if best is not None:
            at, given = best
            self._exchange(taken, int(bins[at]), both[given], [] if at < len(open_bins) else [int(items[at - len(open_bins)])])
            return True
        pairs = [(int(b), total, pair) for b in open_bins for total, pair in self._sums(self.inside[b], 2).items()]
        if not pairs:
            return False
        bins, back = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        best = self._best(taken, singles, bins, back, room)
        if best is None:
            return False
        at, given = best
        self._exchange(taken, int(bins[at]), singles[given], list(pairs[at][2]))
        return True

    def _sums(self, items: list[int], of: int) -> dict[int, tuple[int, ...]]:
        """Sizes of one piece, or of two together, with pieces of that size; equal sizes stand for one another."""
        by_size: dict[int, list[int]] = {}
        for i in items:
            by_size.setdefault(int(self.sizes[i]), []).append(i)
        if of == 1:
            return {size: (found[0],) for size, found in by_size.items()}
        different = sorted(by_size)
        pairs = {2 * size: tuple(by_size[size][:2]) for size in different if len(by_size[size]) > 1}
        for k, a in enumerate(different):
            for b in different[k + 1 :]:
                pairs[a + b] = (by_size[a][0], by_size[b][0])
        return pairs

    def _best(self, taken: int, offers: dict[int, tuple], bins: np.ndarray, back: np.ndarray, room: np.ndarray) -> tuple[int, int] | None:
        """Place in ``bins`` and offer with the largest gain in squared fill; None without a gain."""
        sizes = np.array(sorted(offers), np.int64)
        place = np.searchsorted(sizes, back + room[bins], side="right") - 1
        given = np.where(place >= 0, sizes[place], 0)
        more = given - back
        gain = np.where(more > 0, more * (self.fill[bins] - self.fill[taken] + more), 0)
        at = int(gain.argmax())
        return (at, int(given[at])) if gain[at] > 0 else None

    def _exchange(self, taken: int, other: int, given: tuple[int, ...], back: list[int]) -> None:
        for items, source, target in ((given, taken, other), (back, other, taken)):
            for i in items:
                self.inside[source].remove(i)
                self.inside[target].append(i)
                self.of[i] = target
                self.fill[source] -= self.sizes[i]
                self.fill[target] += self.sizes[i]


def pack_sizes(sizes: list[int], capacity: int, patience: int = PATIENCE) -> tuple[list[int], list[int]]:
    """Bin and offset of every size, in the order given; no size is 0 or above the capacity."""
    bins = Bins(sizes, capacity)
    bins.empty_bins(patience)
    places, offsets = [0] * len(sizes), [0] * len(sizes)
    used = 0
    for found in bins.inside:
        at = 0
        for i in found:
            places[i], offsets[i] = used, at
            at += sizes[i]
        used += bool(found)
    return places, offsets


def place_pieces(pieces: DataFrame, groups: int, length: int = SEQUENCE_LENGTH, seed: int = 42) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length``.

    Sequence ids are unique, not dense. The partition a row comes from is part of
    its hash, so copies of one row are spread over the groups. Groups are dealt
    to as many tasks as the session shuffles to, whatever their number.
    """
    at = len(pieces.columns)
    drawn = F.xxhash64("doc_id", "start", "length", F.spark_partition_id(), F.lit(seed))
    dealt = (
        pieces.withColumn("_group", F.pmod(drawn, F.lit(max(1, groups))).cast("bigint"))
        .repartition("_group")
        .sortWithinPartitions("_group", "length", "doc_id", "start")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, now, used = 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, used
            if count:
                whole = pa.Table.from_batches(held)
                places, offsets = pack_sizes(whole.column("length").to_pylist(), length)
                first = (now << _GROUP_BITS) + used
                used += max(places) + 1
                whole = whole.select(range(at))
                whole = whole.append_column("sequence_id", pa.array([first + p for p in places], pa.int64()))
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
                for cut in range(int(start), int(end), HELD_PIECES):
                    part = batch.slice(cut, min(HELD_PIECES, int(end) - cut))
                    if count + part.num_rows > HELD_PIECES:
                        yield from flush()
                    held.append(part)
                    count += part.num_rows
        yield from flush()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(pack, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE_LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids and their places in the sequences."""
    pieces = packing.token_pieces(docs, tokenizer, length, end_id)
    return place_pieces(pieces, packing.group_count(docs, GROUP_ROWS), length)
