"""Token ids in files of fixed-width bit fields, with block offsets for random access.

A file holds the ids of its documents one after another, each in the least bits
that the vocabulary needs, in blocks of a fixed number of ids that start on whole
bytes. Behind the blocks stand a table of the documents (Arrow), the offsets of
the blocks, and a fixed-size end that says where they are. Blocks are packed and
unpacked with numpy, and a range of ids needs only the blocks it touches.

Files are written by tasks over ranges of document ids, under names of their own.
Only files that a finished task reports are in the manifest, so a task that is
run again leaves nothing that is read. Defined cases: a null or empty text is the
end id alone; equal ids stand next to each other, ordered by a hash of the text;
a null id comes first; no documents give no files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodeline.llm.common import fresh_dir, texts, written
from lodeline.llm.tokenize import encoder

END_ID = 1
BLOCK_IDS = 65_536
_END = struct.Struct("<QQQQIIII")  # start and size of the table, blocks, ids, width, ids of a block, version, magic
_MAGIC, _VERSION = 0x5449424C, 1


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids as big-endian fields of ``width`` bits, zeros up to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> np.ndarray:
    """``count`` ids of ``width`` bits each."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", count).astype(np.uint32)
    bits = np.zeros((count, 32), np.uint8)
    bits[:, 32 - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width).reshape(count, width)
    return np.packbits(bits, axis=1).view(">u4").ravel().astype(np.uint32)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


class IdFileWriter:
    """Writes documents to one file, a block at a time."""

    def __init__(self, stream, width: int, block_ids: int = BLOCK_IDS) -> None:
        self.stream, self.width, self.block_ids = stream, width, block_ids
        self.held: list[np.ndarray] = []
        self.held_ids = self.ids = self.at = 0
        self.offsets: list[int] = []
        self.doc_ids: list = []
        self.starts: list[int] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= self.block_ids:
            whole = np.concatenate(self.held)
            full = len(whole) - len(whole) % self.block_ids
            for start in range(0, full, self.block_ids):
                self._block(whole[start : start + self.block_ids])
            self.held, self.held_ids = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.width)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self, kind: pa.DataType) -> None:
        if self.held_ids:
            self._block(np.concatenate(self.held))
        table = pa.table({"doc_id": pa.array(self.doc_ids, kind), "start": pa.array([*self.starts], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        index = sink.getvalue().to_pybytes()
        self.stream.write(index)
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(_END.pack(self.at, len(index), len(self.offsets), self.ids, self.width, self.block_ids, _VERSION, _MAGIC))
        self.stream.close()


class IdFile:
    """Reads documents, or any range of ids, of one file."""

    def __init__(self, stream) -> None:
        self.stream = stream
        size = stream.size()
        end = self._read(size - _END.size, _END.size)
        self.at, index_size, blocks, self.ids, self.width, self.block_ids, version, magic = _END.unpack(end)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a file of ids")
        index = pa.ipc.open_stream(self._read(self.at, index_size)).read_all()
        self.doc_ids, starts = index.column("doc_id"), index.column("start").to_numpy()
        self.starts = np.append(starts, self.ids)
        self.offsets = np.append(np.frombuffer(self._read(self.at + index_size, 8 * blocks), "<u8"), self.at).astype(np.int64)
        self._kept: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _read(self, start: int, size: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(size)

    def block(self, number: int) -> np.ndarray:
        if self._kept[0] != number:
            start, end = self.offsets[number], self.offsets[number + 1]
            count = min(self.block_ids, self.ids - number * self.block_ids)
            self._kept = number, unpack_bits(self._read(int(start), int(end - start)), self.width, count)
        return self._kept[1]

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``; reads the blocks in between only."""
        if start >= end:
            return np.empty(0, np.uint32)
        parts = []
        for number in range(start // self.block_ids, (end - 1) // self.block_ids + 1):
            first = number * self.block_ids
            parts.append(self.block(number)[max(0, start - first) : end - first])
        return np.concatenate(parts)

    def document(self, place: int) -> np.ndarray:
        return self.range(int(self.starts[place]), int(self.starts[place + 1]))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending order of ``doc_id``; returns the manifest.

    The manifest has ``path, part, n_docs, n_ids, first_id`` per file, in the
    order of ``part``; ``first_id`` is the number of ids in the files before.
    ``tokenizer`` is a path on every executor, ``folder`` one that all share.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, writer, kind = f"{folder}/{uuid.uuid4().hex}.ids", None, None
        for batch in batches:
            encode = encoder(tokenizer)
            if writer is None and len(batch):
                system, root = file_system(folder)
                system.create_dir(root, recursive=True)
                stream = system.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}")
                writer, kind = IdFileWriter(stream, width_of(encode.vocabulary)), batch.column(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(texts(batch.column(1)))):
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close(kind)
            row = {"path": [path], "part": [TaskContext.get().partitionId()], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.ids]}
            yield pa.RecordBatch.from_pydict(row)

    files = written(ranged.mapInArrow(write, "path string, part bigint, n_docs bigint, n_ids bigint"), "manifest")
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, manifest: DataFrame, doc_id_type: str = "bigint") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files; ids as little-endian 32 bits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = file_system(path)
                with system.open_input_file(name) as stream:
                    file = IdFile(stream)
                    step = 512
                    for low in range(0, len(file.doc_ids), step):
                        high = min(low + step, len(file.doc_ids))
                        found = [file.document(i).astype("<u4") for i in range(low, high)]
                        doc_ids = file.doc_ids.slice(low, high - low).combine_chunks()
                        columns = [doc_ids if isinstance(doc_ids, pa.Array) else doc_ids.chunk(0)]
                        columns += [pa.array(file.starts[low:high] + first, pa.int64()), pa.array(list(map(len, found)), pa.int64())]
                        columns.append(pa.array([f.tobytes() for f in found], pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    files = manifest.select("path", "first_id")
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, f"doc_id {doc_id_type}, start bigint, n_tokens bigint, ids binary")
