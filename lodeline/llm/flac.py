"""FLAC streams of one channel of 8-bit samples, many at a time with numpy.

The encoder writes constant, verbatim, fixed and linear-prediction subframes with
partitioned Rice codes, a table of seek points, and the checksums of headers and
frames. The decoder reads any stream of one channel of 8 bits that states its
length and checksum, with wasted bits too; other channel layouts and sample sizes
are refused with a ``ValueError``. It finds the frames by the seek points
or by their sync codes and verified headers, and decodes all frames of a batch
side by side, one sample of each frame per step, as a code's place is only known
when the one before it is read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BLOCK = 4096
SAMPLE_RATE = 8000
LPC_ORDER = 4
LPC_BITS = 12
PARTITION_ORDER = 2
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
_ESCAPE = 15


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    values = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        values = np.where(values & (1 << (bits - 1)), (values << 1) ^ polynomial, values << 1) & ((1 << bits) - 1)
    return values


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


def crc16_of_ranges(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of the data, a byte of each per step."""
    order = np.argsort(-sizes, kind="stable")
    begins, left = starts[order], sizes[order]
    values = np.zeros(len(order), np.int64)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for step, n in enumerate(active):
        now = values[:n]
        values[:n] = ((now << 8) & 0xFFFF) ^ _CRC16[(now >> 8) ^ data[begins[:n] + step]]
    out = np.empty_like(values)
    out[order] = values
    return out


# ---- encoding


@lru_cache(maxsize=65_536)
def frame_header(number: int, samples: int) -> bytes:
    """Fixed block size given in 16 bits, rate from the stream, one channel, 8 bits."""
    coded = chr(number).encode("utf-8", "surrogatepass") if number < 0x110000 else _long_number(number)
    head = b"\xff\xf8\x70\x02" + coded + struct.pack(">H", samples - 1)
    return head + bytes([crc8(head)])


def _long_number(number: int) -> bytes:
    """The longer forms that the format allows beyond those of text."""
    size = next(n for n in range(4, 8) if number < 1 << (5 * n + 1))
    tail = [0x80 | (number >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF << (8 - size)) & 0xFF | number >> (6 * (size - 1)), *tail])


class BitField:
    """Values of up to 32 bits put at bit positions of one buffer; no two overlap."""

    def __init__(self, bits: int) -> None:
        self.words = np.zeros(-(-bits // 32) + 1)

    def put(self, values: np.ndarray, ends: np.ndarray) -> None:
        """Each value's last bit stands before its end; bits of a word add up, as they are disjoint."""
        last = ends - 1
        shifted = values.astype(np.uint64) << (31 - (last & 31)).astype(np.uint64)
        word = last >> 5
        n = len(self.words)
        self.words += np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = shifted >> np.uint64(32)
        over = np.flatnonzero(high)
        self.words += np.bincount(word[over] - 1, high[over].astype(np.float64), n)

    def bytes(self) -> np.ndarray:
        return np.frombuffer(self.words.astype(np.uint64).astype(">u4").tobytes(), np.uint8).copy()


def _levinson(lags: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients of every row of autocorrelations."""
    rows = len(lags)
    coef = np.zeros((rows, order))
    error = np.maximum(lags[:, 0], 1e-9) * (1 + 1e-9)
    for i in range(order):
        back = coef[:, :i][:, ::-1]
        reflect = (lags[:, i + 1] - (coef[:, :i] * lags[:, i:0:-1]).sum(axis=1)) / error
        reflect = np.clip(reflect, -0.9999, 0.9999)
        coef[:, :i] = coef[:, :i] - reflect[:, None] * back
        coef[:, i] = reflect
        error = np.maximum(error * (1 - reflect**2), 1e-9)
    return coef


def _quantised(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = np.maximum(np.abs(coef).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(coef * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int32), shift.astype(np.int32)


def _residual(samples: np.ndarray, coef: np.ndarray, shift: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    predicted = np.zeros(len(samples), np.int32)
    for j in range(coef.shape[1]):
        predicted[j + 1 :] += np.repeat(coef[:, j], sizes)[j + 1 :] * samples[: len(samples) - j - 1]
    return samples - (predicted >> np.repeat(shift, sizes))


def _autocorrelation(samples: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lags 0 to the order of every frame; products across frames do not count."""
    out = []
    for lag in range(LPC_ORDER + 1):
        products = np.zeros(len(samples), np.int32)
        products[lag:] = samples[lag:] * samples[: len(samples) - lag]
        products[(starts[:, None] + np.arange(lag)).ravel()] = 0
        out.append(np.add.reduceat(products, starts))
    return np.stack(out, axis=1).astype(float)


def _runs(items: list, sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of neighbours of about ``most`` in size together."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(items):
        yield slice(start, len(items))


def encode(payloads: list[bytes], at_once: int = 400_000) -> list[bytes]:
    """A stream for every payload; a payload is a positive multiple of 64 unsigned bytes.

    Frames are encoded in runs of about ``at_once`` samples, however long a payload is.
    """
    blocks = [p[start : start + BLOCK] for p in payloads for start in range(0, len(p), BLOCK)]
    numbers = [i for p in payloads for i in range(-(-len(p) // BLOCK))]
    frames: list[bytes] = []
    for run in _runs(blocks, list(map(len, blocks)), at_once):
        frames += _encode_frames(blocks[run], numbers[run])
    out, at = [], 0
    for payload in payloads:
        own = frames[at : at + -(-len(payload) // BLOCK)]
        at += len(own)
        out.append(_stream_head(payload, own) + b"".join(own))
    return out


def _encode_frames(blocks: list[bytes], numbers: list[int]) -> list[bytes]:
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    samples = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int32) - 128
    starts = np.cumsum(sizes) - sizes
    frames = len(sizes)

    # The predictor of each frame: the one with the least sum of residuals and what it costs besides.
    linear, linear_shift = _quantised(_levinson(_autocorrelation(samples, starts), LPC_ORDER))
    none = np.zeros(frames, np.int32)
    kinds = [(o, np.tile(np.array(FIXED[o], np.int32), (frames, 1)), none, 0) for o in (0, 1, 2)]
    kinds.append((LPC_ORDER, linear, linear_shift, 9 + LPC_ORDER * LPC_BITS))
    best = np.full(frames, np.inf)
    residual = samples
    order = np.zeros(frames, np.int64)
    is_linear = np.zeros(frames, bool)
    for o, c, s, extra in kinds:
        found = _residual(samples, c, s, sizes) if o else samples
        sums = np.abs(found)
        sums[(starts[:, None] + np.arange(o)).ravel()] = 0
        cost = sizes * np.log2(2 * np.add.reduceat(sums, starts) / sizes + 1) + 8 * o + extra
        better = cost < best
        best = np.where(better, cost, best)
        residual = np.where(np.repeat(better, sizes), found, residual) if o else samples
        order[better] = o
        is_linear[better] = o == LPC_ORDER

    # Rice parameters of the partitions of each frame.
    parts = 1 << PARTITION_ORDER
    place = np.arange(len(samples)) - np.repeat(starts, sizes)
    coded = place >= np.repeat(order, sizes)
    folded = np.where(coded, (residual << 1) ^ (residual >> 31), 0)
    counts = np.repeat(sizes // parts, parts)
    part_starts = np.cumsum(counts) - counts
    mean = np.add.reduceat(folded, part_starts) / counts
    k = np.clip(np.rint(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(np.int32)
    each_k = np.repeat(k, counts)
    quotient = folded >> each_k

    # What stands before a code: the parameter of its partition, and once the head of the residual.
    size = np.where(coded, quotient + 1 + each_k, 8)
    first = starts + order
    opens = part_starts.copy()
    opens[::parts] = first
    ahead = np.zeros(len(samples), np.int64)
    ahead[opens] += 4
    ahead[first] += 6 + np.where(is_linear, 9 + LPC_ORDER * LPC_BITS, 0)
    body = np.add.reduceat(size + ahead, starts)
    constant = np.maximum.reduceat(samples, starts) == np.minimum.reduceat(samples, starts)
    verbatim = ~constant & (body >= 8 * sizes)
    plain = np.repeat(constant | verbatim, sizes)
    size = np.where(plain, 8, size)
    size[np.repeat(constant, sizes) & (place > 0)] = 0
    ahead[plain] = 0
    body = np.add.reduceat(size + ahead, starts)

    headers = [frame_header(n, int(s)) for n, s in zip(numbers, sizes)]
    head_bytes = np.fromiter(map(len, headers), np.int64, frames)
    frame_bytes = head_bytes + (8 + body + 7) // 8 + 2
    frame_starts = np.cumsum(frame_bytes) - frame_bytes
    base = 8 * (frame_starts + head_bytes) + 8
    within = np.cumsum(size + ahead)
    ends = np.repeat(base - (within[starts] - (size + ahead)[starts]), sizes) + within

    field = BitField(int(8 * frame_bytes.sum()))
    kind = np.where(is_linear, 32 + LPC_ORDER - 1, 8 + order)
    kind = np.where(constant, 0, np.where(verbatim, 1, kind))
    field.put(kind << 1, base)
    rice = coded & ~plain
    field.put(((1 << each_k) | (folded & ((1 << each_k) - 1)))[rice], ends[rice])
    raw = ~rice & (size > 0)
    field.put((samples & 0xFF)[raw], ends[raw])
    coding = ~(constant | verbatim)
    opening = opens[np.repeat(coding, parts)]
    field.put(k[np.repeat(coding, parts)], (ends - size)[opening])
    head_end = (ends - size)[first[coding]] - 4
    field.put(np.full(len(head_end), PARTITION_ORDER), head_end)
    lpc = coding & is_linear
    lpc_end = (ends - size)[first[lpc]] - 10
    for j in range(LPC_ORDER):
        field.put(linear[lpc, j] & ((1 << LPC_BITS) - 1), lpc_end - LPC_BITS * (LPC_ORDER - 1 - j))
    field.put(linear_shift[lpc] & 31, lpc_end - LPC_BITS * LPC_ORDER)
    field.put(np.full(int(lpc.sum()), LPC_BITS - 1), lpc_end - LPC_BITS * LPC_ORDER - 5)

    data = field.bytes()
    for start, header in zip(frame_starts.tolist(), headers):
        data[start : start + len(header)] = np.frombuffer(header, np.uint8)
    checks = crc16_of_ranges(data, frame_starts, frame_bytes - 2)
    data[frame_starts + frame_bytes - 2] = checks >> 8
    data[frame_starts + frame_bytes - 1] = checks & 0xFF

    whole = data.tobytes()
    return [whole[start : start + size] for start, size in zip(frame_starts.tolist(), frame_bytes.tolist())]


def _stream_head(payload: bytes, frames: list[bytes]) -> bytes:
    """Stream information and a seek point for every frame."""
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    most = min(BLOCK, max(16, len(payload)))
    info = struct.pack(">HH", most, most) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (SAMPLE_RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points = zip(range(0, len(payload), BLOCK), np.cumsum(sizes) - sizes)
    table = b"".join(struct.pack(">QQH", at, place, min(BLOCK, len(payload) - at)) for at, place in points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


# ---- decoding


@dataclass
class Stream:
    """What the metadata of a stream says, and where its frames begin."""

    samples: int
    md5: bytes
    first: int
    points: list[tuple[int, int, int]]


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        last, kind = data[at] >> 7, data[at] & 127
        size = int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("one channel of 8 bits is read")
            info = packed & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != 2**64 - 1]
    if info is None:
        raise ValueError("no stream information")
    return Stream(info[0], info[1], at, points)


def read_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Number, samples and size of a frame header whose checksum is right."""
    if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9") or len(data) < at + 6:
        return None
    code, end = data[at + 2] >> 4, at + 4
    lead = data[end]
    extra = 0 if lead < 0x80 else max(0, 7 - (lead ^ 0xFF).bit_length())
    number = lead if not extra else lead & (0x3F >> extra)
    for byte in data[end + 1 : end + extra]:
        number = number << 6 | byte & 0x3F
    end += max(1, extra)
    if code == 6:
        samples, end = data[end] + 1, end + 1
    elif code == 7:
        samples, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    elif code == 1:
        samples = 192
    elif 2 <= code <= 5:
        samples = 576 << (code - 2)
    elif code >= 8:
        samples = 256 << (code - 8)
    else:
        return None
    end += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
    if end >= len(data) or crc8(data[at:end]) != data[end]:
        return None
    return number, samples, end + 1 - at


def frame_starts(data: bytes, stream: Stream) -> list[int]:
    """Starts of all frames, then the end: from the seek points if they cover the stream, else by sync codes."""
    covered = sum(p[2] for p in stream.points)
    if stream.points and covered == stream.samples and stream.points[0][:2] == (0, 0):
        return [stream.first + p[1] for p in stream.points] + [len(data)]
    found, at, wanted, number = [], stream.first, 0, 0
    while wanted < stream.samples:
        at = data.find(b"\xff", at)
        if at < 0:
            raise ValueError("a frame is missing")
        header = read_header(data, at)
        variable = data[at + 1 : at + 2] == b"\xf9"
        if header and header[0] == (wanted if variable else number):
            found.append(at)
            wanted, number = wanted + header[1], number + 1
        at += 1
    return [*found, len(data)]


def _take(data: bytes, bit: int, size: int) -> int:
    last = bit + size
    whole = int.from_bytes(data[bit >> 3 : (last + 7) >> 3], "big")
    return whole >> (-last % 8) & ((1 << size) - 1)


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


@dataclass
class _Lane:
    """A frame to be decoded step by step; positions are bits of the whole buffer."""

    frame: int
    bit: int
    samples: int
    warm: list[int]
    coef: list[int]
    shift: int
    method: int
    partitions: int
    wasted: int


def _open_frame(data: bytes, at: int, base: int, frame: int) -> bytes | _Lane:
    """The signed samples of a plain frame, or the lane that decodes another."""
    header = read_header(data, at)
    if header is None:
        raise ValueError("a frame header is damaged")
    _, samples, size = header
    bit = 8 * (at + size)
    kind, wasted = _take(data, bit, 8) >> 1, _take(data, bit, 8) & 1
    bit += 8
    if wasted:
        # The number of bits in unary; samples are that much narrower.
        while not _take(data, bit, 1):
            wasted, bit = wasted + 1, bit + 1
            if wasted > 7:
                raise ValueError("no bits of a sample are left")
        bit += 1
    held = 8 - wasted
    if kind == 0:
        return bytes([_take(data, bit, held) << wasted]) * samples
    if kind == 1 and not wasted:
        return data[bit >> 3 : (bit >> 3) + samples]
    if kind == 1:
        return bytes(_take(data, bit + held * i, held) << wasted for i in range(samples))
    linear = kind >= 32
    if not linear and not 8 <= kind <= 12:
        raise ValueError("unknown kind of subframe")
    order = kind - 31 if linear else kind - 8
    warm = [_signed(_take(data, bit + held * i, held), held) for i in range(order)]
    bit += held * order
    coef, shift = FIXED.get(order, []), 0
    if linear:
        width, shift = _take(data, bit, 4) + 1, _signed(_take(data, bit + 4, 5), 5)
        coef = [_signed(_take(data, bit + 9 + width * i, width), width) for i in range(order)]
        bit += 9 + width * order
    method, partitions = _take(data, bit, 2), 1 << _take(data, bit + 2, 4)
    if method > 1 or shift < 0:
        raise ValueError("unknown coding of the residual")
    return _Lane(frame, base * 8 + bit + 6, samples, warm, coef, shift, method, partitions, wasted)


def _run_lanes(lanes: list[_Lane], words: np.ndarray) -> list[np.ndarray]:
    """Samples of the lanes; all lanes advance by one sample per step."""
    lanes = sorted(lanes, key=lambda lane: -lane.samples)
    sizes = np.array([lane.samples for lane in lanes])
    orders = np.array([len(lane.warm) for lane in lanes])
    deep = max(1, int(orders.max()))
    coef = np.zeros((deep, len(lanes)), np.int64)
    out = np.zeros((deep + int(sizes[0]), len(lanes)), np.int64)
    opens: dict[int, list[int]] = {}
    for i, lane in enumerate(lanes):
        for j, c in enumerate(lane.coef):
            coef[deep - 1 - j, i] = c
        out[deep : deep + len(lane.warm), i] = lane.warm
        step = lane.samples // lane.partitions
        for start in {max(len(lane.warm), step * p) for p in range(lane.partitions)}:
            opens.setdefault(start, []).append(i)
    shift = np.array([lane.shift for lane in lanes])
    wide = np.array([4 + lane.method for lane in lanes], np.uint64)
    bit = np.array([lane.bit for lane in lanes])
    k = np.zeros(len(lanes), np.uint64)
    raw = np.zeros(len(lanes), np.int64)
    any_raw = False
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
    one, high = np.uint64(1), np.uint64(32)

    def peek(at: np.ndarray) -> np.ndarray:
        return words[at >> 3] << (at & 7).astype(np.uint64)

    for step in range(int(sizes[0])):
        n = int(active[step])
        if step in opens:
            at = np.array(opens[step])
            value = peek(bit[at]) >> (np.uint64(64) - wide[at])
            bit[at] += wide[at].astype(np.int64)
            escaped = value == (one << wide[at]) - one
            raw[at] = -1
            if escaped.any():
                who = at[escaped]
                raw[who] = (peek(bit[who]) >> np.uint64(59)).astype(np.int64)
                bit[who] += 5
                value[escaped] = 0
            k[at] = value
            any_raw = bool((raw >= 0).any())
        now = bit[:n]
        seen = peek(now)
        top = seen >> high
        zeros = 32 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        long_runs = np.flatnonzero(top == 0)
        if len(long_runs):
            if any_raw:
                long_runs = long_runs[raw[long_runs] < 0]
            for lane in long_runs:
                if step < orders[lane]:
                    continue
                start = at_one = int(now[lane])
                while not int(peek(np.array([at_one]))[0]) >> 32:
                    at_one += 32
                at_one += 32 - (int(peek(np.array([at_one]))[0]) >> 32).bit_length()
                zeros[lane] = at_one - start
                seen[lane] = int(peek(np.array([at_one + 1]))[0]) >> 1 | 1 << 63
                zeros[lane] |= 1 << 40  # the word now starts at the one bit
            moved = zeros >> 40
            zeros &= (1 << 40) - 1
            lead = np.where(moved > 0, 0, zeros)
        else:
            lead = zeros
        width = k[:n]
        rest = ((seen << (lead.astype(np.uint64) + one)) >> one) >> (np.uint64(63) - width)
        folded = (zeros.astype(np.uint64) << width) | rest
        error = (folded >> one).astype(np.int64) ^ -(folded & one).astype(np.int64)
        used = zeros + 1 + width.astype(np.int64)
        if any_raw:
            for lane in np.flatnonzero(raw[:n] >= 0):
                bits = int(raw[lane])
                error[lane] = _signed(int(peek(now[lane : lane + 1])[0]) >> (64 - bits), bits) if bits else 0
                used[lane] = bits
        guess = np.einsum("ij,ij->j", coef[:, :n], out[step : step + deep, :n]) >> shift[:n]
        if step < deep:
            ready = orders[:n] <= step
            out[deep + step, :n] = np.where(ready, error + guess, out[deep + step, :n])
            bit[:n] += np.where(ready, used, 0)
        else:
            out[deep + step, :n] = error + guess
            bit[:n] += used
    out[deep:] <<= np.array([lane.wasted for lane in lanes])
    columns = ((out[deep:] + 128) & 0xFF).astype(np.uint8).T.copy()
    return [(lane.frame, columns[i, : lane.samples]) for i, lane in enumerate(lanes)]


def _decode_frames(frames: list[bytes]) -> list[bytes]:
    """Unsigned samples of whole frames; a checksum that is wrong is a ``ValueError``."""
    joined = b"".join(frames)
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(joined + bytes(16), np.uint8)
    ends = starts + sizes
    checks = crc16_of_ranges(flat, starts, sizes - 2)
    if (checks != flat[ends - 2].astype(np.int64) << 8 | flat[ends - 1]).any():
        raise ValueError("the checksum of a frame is wrong")
    opened = [_open_frame(frame, 0, int(start), i) for i, (frame, start) in enumerate(zip(frames, starts))]
    out = [b"" if isinstance(x, _Lane) else (np.frombuffer(x, np.uint8) ^ 0x80).tobytes() for x in opened]
    lanes = [x for x in opened if isinstance(x, _Lane)]
    if lanes:
        words = np.zeros(len(joined) + 8, np.uint64)
        for j in range(8):
            words |= flat[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        for frame, samples in _run_lanes(lanes, words):
            out[frame] = samples.tobytes()
    return out


def decode(streams: list[bytes], at_once: int = 1_500_000) -> list[list[tuple[int, bytes]]]:
    """For every stream its blocks: sample offset and unsigned samples.

    Frames are decoded in runs of about ``at_once`` bytes. Raises ``ValueError``
    where a checksum of a header, a frame or a whole stream is wrong.
    """
    heads, frames, owner = [], [], []
    for doc, data in enumerate(streams):
        heads.append(read_metadata(data))
        places = frame_starts(data, heads[-1])
        frames += [data[at:end] for at, end in zip(places, places[1:])]
        owner += [doc] * (len(places) - 1)
    samples: list[bytes] = []
    for run in _runs(frames, list(map(len, frames)), at_once):
        samples += _decode_frames(frames[run])
    out: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    for doc, block in zip(owner, samples):
        out[doc].append((out[doc][-1][0] + len(out[doc][-1][1]) if out[doc] else 0, block))
    for head, blocks in zip(heads, out):
        whole = b"".join(block for _, block in blocks)
        signed = (np.frombuffer(whole, np.uint8) ^ 0x80).tobytes()
        if len(whole) != head.samples or hashlib.md5(signed).digest() != head.md5:
            raise ValueError("the checksum of a stream is wrong")
    return out
