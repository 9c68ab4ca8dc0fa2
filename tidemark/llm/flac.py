"""FLAC for 8-bit mono PCM: encoding, decoding and seeking, vectorised over frames.

All frames of a batch advance together, one numpy step per sample, so neither the Rice codes nor the predictors are
read one sample of one frame at a time. Every frame has its seek point (sample number, byte offset, samples).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import session

BLOCK = 576
RATE = 8000
#: Frames that advance together; bounds the memory of a step whatever a file's size.
LANES = 2048
#: Samples of a block that predictors of order 0..4 leave over, as weights of the samples before (fixed values of the format).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MAX_LPC = 8
PRECISION = 12


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) else c << 1
            c &= (1 << bits) - 1
        out[i] = c
    return out


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


class Damaged(ValueError):
    """A stream that breaks the format, or whose checksums don't hold."""


def crc16(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the first `lengths` bytes of each row. Rows are right-aligned behind zeros, which leave the CRC at 0."""
    width = rows.shape[1]
    shift = np.arange(width)[None, :] - (width - lengths)[:, None]
    aligned = np.where(shift >= 0, np.take_along_axis(rows, np.maximum(shift, 0), 1), 0).T.copy()
    c = np.zeros(len(rows), dtype=np.uint32)
    for column in aligned:
        c = ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ column]
    return c


def _utf8_number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1)) & 0xFF | n, *reversed(tail)])


def _read_number(b: bytes, at: int) -> tuple[int, int]:
    first = b[at]
    if first < 0x80:
        return first, at + 1
    n = 0
    while first & (0x80 >> n):
        n += 1
    if n == 1 or n > 7:
        raise Damaged("frame number")
    value = first & ((1 << (7 - n)) - 1)
    for k in range(1, n):
        value = value << 6 | b[at + k] & 0x3F
    return value, at + n


def _header(number: int, samples: int) -> bytes:
    code = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5}.get(samples, 7)
    body = b"\xff\xf8" + bytes([code << 4 | 4, 0b0000_0010]) + _utf8_number(number) + (struct.pack(">H", samples - 1) if code == 7 else b"")
    c = 0
    for x in body:
        c = int(CRC8[c ^ x])
    return body + bytes([c])


def _packed(values: np.ndarray, widths: np.ndarray, zeros: np.ndarray) -> list[bytes]:
    """Each row's codes, most significant bit first: `zeros` zero bits, then the low `widths` (at most 16) bits of `values`."""
    ends = np.cumsum(widths + zeros, axis=1)
    words = (ends[:, -1] >> 5) + 1
    base = np.concatenate([[0], np.cumsum(words)])
    start = ((ends - widths) + base[:-1, None] * 32).ravel()
    v, width = (values & ((1 << widths) - 1)).ravel(), widths.ravel()
    word, room = start >> 5, 32 - (start & 31) - width
    high = np.where(room >= 0, v << np.maximum(room, 0), v >> np.maximum(-room, 0))
    out = np.zeros(base[-1], dtype=np.int64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= (v[over] << (32 + room[over])) & 0xFFFFFFFF
    data = out.astype(">u4").tobytes()
    return [data[4 * a : 4 * a + -(-n // 8)] for a, n in zip(base[:-1].tolist(), ends[:, -1].tolist(), strict=True)]


def _lpc(blocks: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantized predictor weights (last sample first), their shift, and the residuals, by Levinson-Durbin."""
    x = (blocks * np.hanning(blocks.shape[1] + 2)[1:-1]).astype(np.float32)
    n = x.shape[1]
    auto = np.stack([np.einsum("ij,ij->i", x[:, : n - k], x[:, k:]) for k in range(order + 1)], 1).astype(np.float64) + 1e-9
    err, a = auto[:, 0].copy(), np.zeros((len(x), order))
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / err
        k = np.clip(k, -0.999, 0.999)
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.abs(a).max(1) + 1e-12)).astype(np.int64), 0, 14)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int64)
    s, w = blocks.astype(np.int32), q.astype(np.int32)
    guess = sum(w[:, k : k + 1] * s[:, order - 1 - k : n - 1 - k] for k in range(order)) >> shift[:, None].astype(np.int32)
    return q, shift, s[:, order:] - guess


def _rice_bits(res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Rice parameter for each row, the best of three about the one that the mean suggests, and its bits."""
    fold = (res << 1) ^ (res >> 31)
    n = res.shape[1]
    near = np.clip(np.log2(np.maximum(fold.sum(1, dtype=np.int64) / n * 0.7, 1)).astype(np.int32), 0, 14)
    tried = np.clip(near[:, None] + np.array([-1, 0, 1], dtype=np.int32), 0, 14)
    costs = np.stack([(fold >> tried[:, j : j + 1]).sum(1, dtype=np.int64) + n * (tried[:, j] + 1) for j in range(3)], 1)
    best = costs.argmin(1)
    lane = np.arange(len(res))
    return tried[lane, best], costs[lane, best]


def encode_frames(blocks: np.ndarray, numbers: Sequence[int], lpc_order: int = MAX_LPC) -> list[bytes]:
    """A frame for each row of samples (-128..127), each coded the shortest way: constant, verbatim, fixed or LPC."""
    blocks = blocks.astype(np.int32)
    rows, n = blocks.shape
    constant = (blocks == blocks[:, :1]).all(1)
    best, how = np.full(rows, 8 * n), np.full(rows, -1)
    rice = np.zeros(rows, dtype=np.int32)
    residuals: dict[int, np.ndarray] = {0: blocks}
    for order in range(1, min(5, n)):
        residuals[order] = residuals[order - 1][:, 1:] - residuals[order - 1][:, :-1]
    sizes = np.stack([np.abs(r).sum(1) for r in residuals.values()], 1)
    likely = sizes.argmin(1)
    for order in np.unique(likely).tolist():
        at = np.flatnonzero(likely == order)
        k, bits = _rice_bits(residuals[order][at])
        bits = bits + 8 * order + 10
        at, k, bits = (x[bits < best[at]] for x in (at, k, bits))
        best[at], how[at], rice[at] = bits, order, k
    weights = shifts = None
    if 0 < lpc_order < n:
        weights, shifts, diff = _lpc(blocks, lpc_order)
        residuals[8] = diff.astype(np.int32)
        k, bits = _rice_bits(residuals[8])
        bits = bits + 8 * lpc_order + 9 + PRECISION * lpc_order + 10
        better = bits < best
        best, how, rice = np.where(better, bits, best), np.where(better, 8, how), np.where(better, k, rice)
    how[constant] = -2
    bodies: list[bytes] = [b""] * rows
    for kind in np.unique(how).tolist():
        at = np.flatnonzero(how == kind)
        part = blocks[at].astype(np.int64)
        if kind == -2:
            for i in at.tolist():
                bodies[i] = bytes([0, int(blocks[i, 0]) & 0xFF])
            continue
        if kind == -1:
            for i, row in zip(at.tolist(), (part & 0xFF).astype(np.uint8), strict=True):
                bodies[i] = b"\x02" + row.tobytes()
            continue
        order = lpc_order if kind == 8 else kind
        res = residuals[kind][at].astype(np.int64)
        fold = (res << 1) ^ (res >> 63)
        k = rice[at][:, None].astype(np.int64)
        one = np.ones((len(at), 1), dtype=np.int64)
        values, widths = [one * ((32 + order - 1 if kind == 8 else 8 + order) << 1)], [one * 8]
        values += [part[:, j : j + 1] & 0xFF for j in range(order)]
        widths += [one * 8] * order
        if kind == 8:
            values += [one * (PRECISION - 1), shifts[at][:, None]] + [weights[at][:, j : j + 1] & ((1 << PRECISION) - 1) for j in range(order)]
            widths += [one * 4, one * 5] + [one * PRECISION] * order
        values += [one * 0, one * 0, k]
        widths += [one * 2, one * 4, one * 4]
        zeros = np.zeros((len(at), len(values) + fold.shape[1]), dtype=np.int64)
        zeros[:, len(values) :] = fold >> k
        packed = _packed(np.concatenate([*values, fold & ((1 << k) - 1) | 1 << k], 1), np.concatenate([*widths, np.broadcast_to(k + 1, fold.shape)], 1), zeros)
        for i, row in zip(at.tolist(), packed, strict=True):
            bodies[i] = row
    frames = [_header(number, n) + body for number, body in zip(numbers, bodies, strict=True)]
    lengths = np.array([len(f) for f in frames])
    table = np.zeros((rows, lengths.max(initial=0)), dtype=np.uint8)
    for i, f in enumerate(frames):
        table[i, : len(f)] = np.frombuffer(f, dtype=np.uint8)
    return [f + struct.pack(">H", c) for f, c in zip(frames, crc16(table, lengths).tolist(), strict=True)]


def stream_head(samples: int, frame_sizes: Sequence[int], md5: bytes, block: int = BLOCK) -> bytes:
    """The marker, STREAMINFO and the seek table."""
    least, most = (min(frame_sizes), max(frame_sizes)) if frame_sizes else (0, 0)
    info = struct.pack(">HH", block, block) + least.to_bytes(3, "big") + most.to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + md5
    points, at = bytearray(), 0
    for i, size in enumerate(frame_sizes):
        points += struct.pack(">QQH", i * block, at, min(block, samples - i * block))
        at += size
    out = [b"fLaC", bytes([0]), len(info).to_bytes(3, "big"), info]
    chunk = 18 * 900_000  # a metadata block holds less than 16 MiB
    parts = [points[i : i + chunk] for i in range(0, len(points), chunk)] or [b""]
    for i, p in enumerate(parts):
        out += [bytes([3 | (0x80 if i == len(parts) - 1 else 0)]), len(p).to_bytes(3, "big"), bytes(p)]
    return b"".join(out)


def encode_many(payloads: Sequence[bytes], block: int = BLOCK, lpc_order: int = MAX_LPC) -> list[bytes]:
    """A FLAC file for each payload of 8-bit unsigned samples (stored as signed, less 128)."""
    frames: list[list[bytes]] = [[b""] * (-(-len(p) // block)) for p in payloads]
    jobs = [(i, k) for i, p in enumerate(payloads) for k in range(len(p) // block)]
    for at in range(0, len(jobs), LANES):
        part = jobs[at : at + LANES]
        raw = np.frombuffer(b"".join(payloads[i][k * block : (k + 1) * block] for i, k in part), dtype=np.uint8).reshape(len(part), block)
        for (i, k), f in zip(part, encode_frames(raw.astype(np.int64) - 128, [k for _, k in part], lpc_order), strict=True):
            frames[i][k] = f
    for i, p in enumerate(payloads):
        if len(p) % block:
            rest = np.frombuffer(p[len(p) // block * block :], dtype=np.uint8)[None, :].astype(np.int64) - 128
            frames[i][-1] = encode_frames(rest, [len(p) // block], lpc_order)[0]
    return [stream_head(len(p), [len(x) for x in f], hashlib.md5(np.frombuffer(p, np.uint8).__xor__(np.uint8(128)).tobytes()).digest(), block) + b"".join(f) for p, f in zip(payloads, frames, strict=True)]


class Reader:
    """The metadata of a file: stream information and where each frame begins."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:4] != b"fLaC":
            raise Damaged("marker")
        at, last, points = 4, False, []
        self.samples = None
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if len(body) < size:
                raise Damaged("metadata")
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
                self.block, self.md5 = struct.unpack(">H", body[2:4])[0], body[18:34]
            elif kind == 3:
                points += [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
            at += 4 + size
        if self.samples is None:
            raise Damaged("no stream information")
        if self.channels != 1 or self.bits != 8:
            raise Damaged("only mono 8-bit streams are read")
        self.first = at
        self.points = points if sum(p[2] for p in points) == self.samples else self._scanned()

    def _scanned(self) -> list[tuple[int, int, int]]:
        """Seek points found by the frames' sync codes and header checksums, each settled by the frame checksum."""
        out, at, d, begins = [], self.first, self.data, 0
        while at < len(d):
            samples, _ = frame_header(d, at)
            c, end = 0, None
            for k in range(at, len(d)):
                c = (c << 8 & 0xFFFF) ^ int(CRC16[c >> 8 ^ d[k]])
                if c == 0 and k > at + 6 and (k + 1 == len(d) or d[k + 1 : k + 3] == b"\xff\xf8"):
                    end = k + 1
                    break
            if end is None:
                raise Damaged("frame checksum")
            out.append((begins, at - self.first, samples))
            begins, at = begins + samples, end
        return out

    def frames(self, start: int = 0, stop: int | None = None) -> list[tuple[bytes, int]]:
        """(frame, samples) of the frames that hold samples start..stop."""
        stop = self.samples if stop is None else stop
        ends = [p[1] for p in self.points[1:]] + [len(self.data) - self.first]
        return [(self.data[self.first + p[1] : self.first + e], p[2]) for p, e in zip(self.points, ends, strict=True) if p[0] < stop and p[0] + p[2] > start]


def frame_header(d: bytes, at: int) -> tuple[int, int]:
    """Samples of the frame at `at`, and where its subframe begins."""
    if d[at : at + 2] != b"\xff\xf8":
        raise Damaged("sync code")
    code = d[at + 2] >> 4
    _, k = _read_number(d, at + 4)
    if code == 6:
        samples, k = d[k] + 1, k + 1
    elif code == 7:
        samples, k = struct.unpack(">H", d[k : k + 2])[0] + 1, k + 2
    elif 1 <= code <= 5:
        samples = 192 if code == 1 else 576 << (code - 2)
    elif code >= 8:
        samples = 256 << (code - 8)
    else:
        raise Damaged("block size")
    rate = d[at + 2] & 15
    k += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    c = 0
    for x in d[at:k]:
        c = int(CRC8[c ^ x])
    if c != d[k]:
        raise Damaged("header checksum")
    return samples, k + 1


class Bits:
    """A cursor over the bits of every lane."""

    def __init__(self, rows: np.ndarray, at: np.ndarray):
        self.width = rows.shape[1] + 16
        self.bytes = np.zeros((len(rows), self.width), dtype=np.uint8)
        self.bytes[:, : rows.shape[1]] = rows
        #: Eight bytes from any byte on, as one big-endian number.
        self.words = np.ndarray((self.bytes.size - 7,), dtype=">u8", buffer=self.bytes, strides=(1,))
        self.base = np.arange(len(rows)) * self.width
        self.at = at

    def window(self) -> np.ndarray:
        """The next bits of each lane (57 at least), from the top of a 64-bit number on."""
        byte = self.base + np.minimum(self.at >> 3, self.width - 8)
        return self.words[byte].astype(np.uint64) << (self.at & 7).astype(np.uint64)

    def take(self, widths: np.ndarray | int) -> np.ndarray:
        """The next bits of each lane (at most 32) as an unsigned number."""
        out = (self.window() >> np.uint64(1) >> (63 - np.asarray(widths)).astype(np.uint64)).astype(np.int64)
        self.at = self.at + widths
        return out

    def unary(self, on: np.ndarray | None = None) -> np.ndarray:
        """Zeros before the next one bit, which is passed too; in the lanes that are on, if given."""
        total = np.zeros(len(self.at), dtype=np.int64)
        while True:
            top = (self.window() >> np.uint64(11)).astype(np.float64)
            if on is not None:
                top[~on] = 1 << 52
            lead = 1075 - (top.view(np.int64) >> 52)
            long = top == 0
            if not long.any():
                break
            if (self.at > self.width * 8).any():
                raise Damaged("residuals")
            total += np.where(long, 46, 0)
            self.at = self.at + np.where(long, 46, 0)
        step = lead if on is None else np.where(on, lead, -1)
        self.at = self.at + step + 1
        return total + np.maximum(step, 0)


def _signed(x: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    half = np.int64(1) << (np.asarray(bits) - 1)
    return np.where(x >= half, x - 2 * half, x)


def decode_frames(frames: Sequence[tuple[bytes, int]]) -> np.ndarray:
    """The samples of frames of equal length in samples, one row each. Verifies both checksums of every frame."""
    n = frames[0][1]
    lengths = np.array([len(f) for f, _ in frames])
    rows = np.zeros((len(frames), lengths.max()), dtype=np.uint8)
    begins = np.empty(len(frames), dtype=np.int64)
    for i, (f, samples) in enumerate(frames):
        rows[i, : len(f)] = np.frombuffer(f, dtype=np.uint8)
        told, begins[i] = frame_header(f, 0)
        if told != samples or samples != n:
            raise Damaged("samples of a frame")
    if crc16(rows, lengths).any():
        raise Damaged("frame checksum")
    kind = rows[np.arange(len(rows)), begins].astype(np.int64)
    if (kind & 0x81).any():
        raise Damaged("subframe header")
    kind >>= 1
    out = np.zeros((len(frames), n), dtype=np.int64)
    if (at := np.flatnonzero(kind == 0)).size:
        out[at] = _signed(rows[at, begins[at] + 1].astype(np.int64), 8)[:, None]
    if (at := np.flatnonzero(kind == 1)).size:
        out[at] = _signed(np.take_along_axis(rows[at], begins[at][:, None] + 1 + np.arange(n), 1).astype(np.int64), 8)
    for k in np.unique(kind[kind > 1]).tolist():
        at = np.flatnonzero(kind == k)
        out[at] = _predicted(rows[at], begins[at], k, n)
    return out


def _predicted(rows: np.ndarray, begins: np.ndarray, kind: int, n: int) -> np.ndarray:
    """Fixed or LPC subframes of one order: warm-up samples, weights, then Rice residual and prediction of each sample."""
    lpc = kind >= 32
    if not lpc and not 8 <= kind <= 12:
        raise Damaged("subframe kind")
    order = kind - 31 if lpc else kind - 8
    lanes = len(rows)
    bits = Bits(rows, begins * 8 + 8)
    out = np.zeros((n, lanes), dtype=np.int64)
    for j in range(order):
        out[j] = _signed(bits.take(8), 8)
    shift = np.zeros(lanes, dtype=np.int64)
    if lpc:
        precision = bits.take(4) + 1
        shift = _signed(bits.take(5), 5)
        if (shift < 0).any():
            raise Damaged("negative shift")
        weights = [_signed(bits.take(precision), precision) for _ in range(order)]
    else:
        weights = list(FIXED[order])
    method = bits.take(2)
    if (method > 1).any():
        raise Damaged("residual coding")
    width = np.where(method == 1, 5, 4)
    span = n >> bits.take(4)
    if (n % np.maximum(span, 1)).any() or (span < 1).any():
        raise Damaged("partitions")
    k, raw, least = np.zeros(lanes, dtype=np.int64), np.full(lanes, -1), int(np.gcd.reduce(span))
    for t in range(order, n):
        if t == order or t % least == 0:
            fresh = (t % span == 0) | (t == order)
            got = bits.take(np.where(fresh, width, 0))
            k = np.where(fresh, got, k)
            escape = fresh & (got == (1 << width) - 1)
            told = bits.take(np.where(escape, 5, 0))
            raw = np.where(escape, told, np.where(fresh, -1, raw))
            any_raw = (raw >= 0).any()
        if any_raw:
            plain = raw >= 0
            high = bits.unary(~plain)
            low = bits.take(np.where(plain, raw, k))
            fold = high << k | low
            res = np.where(plain, np.where(raw > 0, _signed(low, np.maximum(raw, 1)), 0), (fold >> 1) ^ -(fold & 1))
        else:
            fold = bits.unary() << k
            fold |= bits.take(k)
            res = (fold >> 1) ^ -(fold & 1)
        if order:
            guess = weights[0] * out[t - 1]
            for j in range(1, order):
                guess += weights[j] * out[t - 1 - j]
            res += guess >> shift
        out[t] = res
    return out.T


def decode_many(files: Sequence[bytes], verify: bool = True) -> list[bytes]:
    """The payload of each file, as 8-bit unsigned samples."""
    readers = [Reader(f) for f in files]
    lanes: dict[int, list[tuple[int, int, bytes]]] = {}
    out = [np.empty(r.samples, dtype=np.uint8) for r in readers]
    for i, r in enumerate(readers):
        for p, (frame, samples) in zip(r.points, r.frames(), strict=True):
            lanes.setdefault(samples, []).append((i, p[0], frame))
    for samples, jobs in lanes.items():
        for at in range(0, len(jobs), LANES):
            part = jobs[at : at + LANES]
            got = (decode_frames([(f, samples) for _, _, f in part]) + 128).astype(np.uint8)
            for (i, begin, _), row in zip(part, got, strict=True):
                out[i][begin : begin + samples] = row
    if verify:
        for r, x in zip(readers, out, strict=True):
            if r.md5 != bytes(16) and hashlib.md5((x ^ np.uint8(128)).tobytes()).digest() != r.md5:
                raise Damaged("checksum of the samples")
    return [x.tobytes() for x in out]


def read_samples(data: bytes, start: int, stop: int) -> bytes:
    """Samples start..stop of a file; only the frames that hold them are decoded."""
    r = Reader(data)
    start, stop = max(0, start), min(stop, r.samples)
    chosen = [p for p in r.points if p[0] < stop and p[0] + p[2] > start]
    got = b"".join((decode_frames([f])[0] + 128).astype(np.uint8).tobytes() for f in r.frames(start, stop))
    return got[start - chosen[0][0] :][: stop - start] if chosen else b""


def padded(payload: bytes, block: int = BLOCK) -> bytes:
    return payload + b"\xff" * (-len(payload) % block if payload else block)


def features(samples: np.ndarray) -> str:
    """Mean, root mean square, zero crossings and peak of the PCM (samples less 128)."""
    x = samples.astype(np.int64) - 128
    return f"n={len(x)};sum={int(x.sum())};square={int((x * x).sum())};cross={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())}"


def _some(keys: list, values: pa.Array, most: int) -> Iterator[tuple[list, list[bytes]]]:
    """A batch's texts or files, as bytes, up to `most` bytes at a time (or one that is longer)."""
    who, group, size = [], [], 0
    for k, x in zip(keys, values, strict=True):
        b = x.as_py() or b""
        b = b.encode() if isinstance(b, str) else b
        if group and size + len(b) > most:
            yield who, group
            who, group, size = [], [], 0
        who.append(k)
        group.append(b)
        size += len(b) + BLOCK
    if group:
        yield who, group


def store_media(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_bytes and media, the FLAC file of the text's UTF-8 (null: empty) and bytes 255 up
    to a positive multiple of `block`. Repeated rows and null ids are kept; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, group in _some(batch.column(0).to_pylist(), batch.column(1), block * LANES // 2):
                files = encode_many([padded(b, block) for b in group], block)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(list(map(len, group)), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    session(df)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_blocks(media: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """The PCM blocks of stored files (doc_id, media) that hold samples start..stop: doc_id, block, sample_offset,
    byte_offset (of the frame, in the file), samples, pcm (8-bit unsigned).

    Only the frames in question are decoded, LANES at a time; each one's checksums are verified, and the file's own where
    all of it is read. Null files give no blocks, rows that repeat give theirs again.
    """
    names, kinds = ["doc_id", "block", "sample_offset", "byte_offset", "samples", "pcm"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not x.is_valid:
                    continue
                r, md5 = Reader(x.as_py()), hashlib.md5()
                end = r.samples if stop is None else min(stop, r.samples)
                chosen = [(k, p) for k, p in enumerate(r.points) if p[0] < end and p[0] + p[2] > start]
                frames = r.frames(start, end)
                for at in range(0, len(chosen), LANES):
                    rows = []
                    for size, part in groupby(zip(chosen[at : at + LANES], frames[at : at + LANES], strict=True), key=lambda c: c[1][1]):
                        part = list(part)
                        pcm = (decode_frames([f for _, f in part]) + 128).astype(np.uint8)
                        md5.update((pcm ^ np.uint8(128)).tobytes())
                        rows += [(doc, k, p[0], r.first + p[1], size, row.tobytes()) for ((k, p), _), row in zip(part, pcm, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                if len(chosen) == len(r.points) and r.md5 not in (bytes(16), md5.digest()):
                    raise Damaged("checksum of the samples")

    session(media)
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, block long, sample_offset long, byte_offset long, samples int, pcm binary")


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Stores every text as a FLAC file in a column (store_media), reads that back, and describes both.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and blocks
    (the PCM blocks' count). Equal texts give equal values; repeated rows and null ids are kept; columns other than the
    two named are not read; an empty table gives an empty result. A text of any length is coded LANES blocks at a time.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for who, files in _some(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(2), block * LANES // 2):
                rows = []
                for (doc, n), media, back in zip(who, files, decode_many(files), strict=True):
                    rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(back, np.uint8)), len(back) // block))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return store_media(df, key, text, block).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks long")
