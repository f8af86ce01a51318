"""Media columns: bytes as lossless audio, and the blocks that are decoded from it.

Defined cases: a null text is empty, and an empty one is a payload of zeros;
equal texts have equal media; a null or damaged media value gives no blocks, and
its ``error`` says why; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm import flac
from lodeline.llm.common import utf8

UNIT = 64


def payload_of(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of the unit."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def _slices(batch: pa.RecordBatch, column: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of bytes, one row at least."""
    sizes = [0 if v is None else len(v) for v in batch.column(column).cast(pa.binary()).to_pylist()]
    for run in flac._runs(sizes, sizes, most):
        yield batch.slice(run.start, run.stop - run.start)


def encode_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a FLAC stream of 8-bit samples."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                found = utf8(batch.column(1))
                media = flac.encode([payload_of(text) for text in found])
                columns = [batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_bytes bigint, media binary")


def _decoded(media: list[bytes | None]) -> list[tuple[list[tuple[int, bytes]], str | None]]:
    """Blocks and error of each value; damaged ones are found one by one."""
    present = [m for m in media if m is not None]
    try:
        blocks = iter(flac.decode(present))
        return [([], "no media") if m is None else (next(blocks), None) for m in media]
    except (ValueError, IndexError, OverflowError) as error:
        if len(media) == 1:
            return [([], str(error))]
        return [_decoded([m])[0] for m in media]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``doc_id, block_no, sample_offset, n_samples, pcm, error`` from ``doc_id, media``.

    Blocks are in order and cover the samples, so any sample is found by its
    offset. A value that cannot be decoded is one row with the error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                rows = []
                for doc_id, (blocks, error) in zip(batch.column(0).to_pylist(), _decoded(batch.column(1).to_pylist())):
                    rows += [(doc_id, i, at, len(pcm), pcm, None) for i, (at, pcm) in enumerate(blocks)]
                    if error:
                        rows.append((doc_id, None, None, None, None, error))
                kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block_no", "sample_offset", "n_samples", "pcm", "error"])

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, block_no bigint, sample_offset bigint, n_samples bigint, pcm binary, error string"
    return media.select("doc_id", "media").mapInArrow(decode, schema)


def feature_of(samples: np.ndarray) -> str:
    """Loudness, peak and rate of sign changes of signed samples."""
    signed = samples.astype(np.float64)
    loudness = float(np.sqrt((signed * signed).mean()))
    changes = int((np.signbit(signed[1:]) != np.signbit(signed[:-1])).sum())
    return f"rms={loudness:.4f};peak={int(np.abs(signed).max())};changes={changes}"


def measured(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    All but ``n_bytes`` come from the stored bytes: the payload is what the
    blocks decode to, and is null where they do not.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2):
                media_values = batch.column(2).to_pylist()
                rows = []
                for stored, (blocks, error) in zip(media_values, _decoded(media_values)):
                    stored = stored or b""
                    own = (len(stored), hashlib.sha256(stored).hexdigest())
                    if error:
                        rows.append((None, None, None, *own, None))
                        continue
                    payload = b"".join(pcm for _, pcm in blocks)
                    samples = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
                    tail = zlib.crc32(payload[-UNIT:])
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), tail, *own, feature_of(samples)))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [batch.column(0), batch.column(1)]
                columns += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(measure, schema)
