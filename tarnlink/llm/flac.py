"""FLAC media columns: encode bytes as 8-bit mono FLAC, decode 8-bit mono FLAC streams in blocks of 192 samples.

A value is a whole FLAC file: marker, STREAMINFO (with the MD5 of the samples), a SEEKTABLE, and frames of BLOCK
samples. A sample is a byte less 128. The encoder picks, block by block, a constant, verbatim, fixed (order 0-2)
or linear-predictive (order up to `lpc`) subframe with Rice-coded residuals, whichever is shortest. The decoder reads
residuals in all partition orders and both Rice widths, undoes the predictors, checks each header's CRC-8, each
frame's CRC-16 and the stream's MD5, and gives blocks of PCM with their sample offsets. Streams with other block sizes, with
wasted bits or with unencoded (escaped) residual partitions are refused with ValueError.

Frames are found by their headers, which pass a CRC and bear the right number; where bytes within a frame look like the next
one's header, the file is read frame by frame instead, each beginning where the one before ends.

numpy works on all blocks of a slab side by side: bit positions are found by one short loop over the samples of a
block, everything else is done in one go over the slab. Memory is bounded by the slab, not by the batch or text.

Defined cases: null and empty texts are stored as one block of spaces; a null file has no PCM blocks and null features; a damaged
or truncated file, or one with bytes after its last frame, raises ValueError, which names the block where it is in one; equal
texts and repeated rows give equal files; an empty table gives no rows; other columns are kept, and those named like an added
column are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, results, text_batches
from .wordhash import raw

#: Samples in a block. 192 has a block-size code of its own (1).
BLOCK = 192
RATE = 8000
#: Blocks worked on at once.
SLAB = 4096
#: A seek point for every so many blocks, the first included.
SEEK_EVERY = 8
_PAD = 8


def _crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint32)
    for i in range(256):
        r = i << (bits - 8)
        for _ in range(8):
            r = (r << 1) ^ (poly if r >> (bits - 1) else 0)
            r &= (1 << bits) - 1
        t[i] = r
    return t


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(frames: np.ndarray) -> np.ndarray:
    """CRC-16 of each row; rows are right-aligned, since leading zeros don't change it."""
    r = np.zeros(len(frames), dtype=np.uint32)
    for col in np.ascontiguousarray(frames.T):
        r = ((r << 8) & 0xFFFF) ^ _CRC16[(r >> 8) ^ col]
    return r


def crc8(heads: np.ndarray) -> np.ndarray:
    r = np.zeros(len(heads), dtype=np.uint32)
    for col in np.ascontiguousarray(heads.T):
        r = _CRC8[r ^ col]
    return r


def _number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    first = (0xFF00 >> (more + 1)) & 0xFF
    return bytes([first | (n >> (6 * more))] + [0x80 | (n >> (6 * i)) & 0x3F for i in range(more - 1, -1, -1)])


_head_cache: dict[int, bytes] = {}


def _header(n: int) -> bytes:
    """The frame header of block n, its CRC-8 included: fixed size 192, rate from STREAMINFO, mono, 8 bits."""
    if (h := _head_cache.get(n)) is None:
        h = b"\xff\xf8\x10\x02" + _number(n)
        h += bytes([int(crc8(np.frombuffer(h, np.uint8)[None])[0])])
        if len(_head_cache) < 1 << 16:
            _head_cache[n] = h
    return h


def _lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients (7-bit, shift 5) of each row's predictor by Levinson-Durbin, and where they're usable."""
    n, width = x.shape
    f = x.astype(np.float64) * np.hanning(width + 2)[1:-1]
    r = np.stack([(f[:, : width - i] * f[:, i:]).sum(1) for i in range(order + 1)], 1)
    a, err = np.zeros((n, order)), r[:, 0] + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = err * (1 - k * k)
    q = np.round(a * 32)
    ok = (np.abs(q) <= 63).all(1)
    q = np.where(ok[:, None], q, 0).astype(np.int64)
    guess = np.zeros_like(x, dtype=np.int64)
    for i in range(order):
        guess[:, order:] += q[:, i : i + 1] * x[:, order - 1 - i : width - 1 - i]
    res = x.astype(np.int64) - (guess >> 5)
    return q, ok, res


def encode_blocks(x: np.ndarray, numbers: np.ndarray, lpc: int = 2) -> list[bytes]:
    """Frames for the rows of x (int samples, BLOCK wide), numbered."""
    n, width = x.shape
    x = x.astype(np.int64)
    kinds, warm, residuals, usable = [], [], [], []
    d = x
    for order in range(3):
        if order:
            d = np.diff(d, axis=1)
        kinds.append(0b001000 + order)
        warm.append(order)
        residuals.append(np.concatenate((np.zeros((n, order), np.int64), d), 1))
        usable.append(np.ones(n, bool))
    coef = None
    if lpc:
        coef, ok, res = _lpc(x, lpc)
        kinds.append(0b100000 + lpc - 1)
        warm.append(lpc)
        residuals.append(res)
        usable.append(ok)
    best_bits, best, best_k = np.full(n, 8 * width + 8, np.int64), np.full(n, -1), np.zeros(n, np.int64)
    zig = []
    for c, res in enumerate(residuals):
        z = np.where(res < 0, -2 * res - 1, 2 * res)
        z[:, : warm[c]] = 0
        zig.append(z)
        base = 8 + 8 * warm[c] + 10 + (9 + 7 * lpc if kinds[c] >= 32 else 0)
        mean = z.sum(1) / (width - warm[c])
        k0 = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7 + 0.3)), 0, 13).astype(np.int64)
        for k in (k0, np.minimum(k0 + 1, 14)):
            bits = base + ((z >> k[:, None])[:, warm[c] :] + 1 + k[:, None]).sum(1)
            better = usable[c] & (bits < best_bits)
            best_bits, best, best_k = np.where(better, bits, best_bits), np.where(better, c, best), np.where(better, k, best_k)
    flat = (x == x[:, :1]).all(1)
    best = np.where(flat, -2, best)
    frames: list[bytes] = [b""] * n
    for c in np.unique(best).tolist():
        rows = np.flatnonzero(best == c)
        m = len(rows)
        xs, body = x[rows], None
        if c == -2:
            body = np.concatenate((np.zeros((m, 1), np.uint8), (xs[:, :1] & 255).astype(np.uint8)), 1)
        elif c == -1:
            body = np.concatenate((np.full((m, 1), 2, np.uint8), (xs & 255).astype(np.uint8)), 1)
        if body is not None:
            for i, b in zip(rows.tolist(), body, strict=True):
                frames[i] = _header(int(numbers[i])) + b.tobytes()
            continue
        k, w = best_k[rows], warm[c]
        z = zig[c][rows][:, w:]
        head = [np.full(m, kinds[c] << 1), *(xs[:, i] & 255 for i in range(w))]
        sizes = [8] * (1 + w)
        if kinds[c] >= 32:
            head += [np.full(m, 6), np.full(m, 5), *(coef[rows][:, i] & 127 for i in range(lpc))]
            sizes += [4, 5, *([7] * lpc)]
        head += [np.zeros(m, np.int64), k]  # Rice with 4-bit parameters, one partition
        sizes += [6, 4]
        fixed = sum(sizes)
        lengths = (z >> k[:, None]) + 1 + k[:, None]
        total = fixed + lengths.sum(1)
        octets = (total + 7) // 8
        starts = np.cumsum(octets * 8) - octets * 8
        bits = np.zeros(int(octets.sum()) * 8, np.uint8)
        at = starts.copy()
        for v, size in zip(head, sizes, strict=True):
            for j in range(size):
                bits[at + j] = (v >> (size - 1 - j)) & 1
            at += size
        ends = starts[:, None] + fixed + np.cumsum(lengths, 1)  # past the last bit of each code
        bits[ends - 1 - k[:, None]] = 1
        for j in range(int(k.max()) if m else 0):
            some = k > j
            bits[ends[some] - 1 - j] = (z[some] >> j) & 1
        packed = np.packbits(bits).tobytes()
        edges = np.concatenate((starts // 8, [len(packed)])).tolist()
        for i, a, b in zip(rows.tolist(), edges[:-1], edges[1:], strict=True):
            frames[i] = _header(int(numbers[i])) + packed[a:b]
    longest = max(map(len, frames), default=0)
    padded = np.zeros((n, longest), np.uint8)
    for i, f in enumerate(frames):
        padded[i, longest - len(f) :] = np.frombuffer(f, np.uint8)
    return [f + struct.pack(">H", c) for f, c in zip(frames, crc16(padded).tolist(), strict=True)]


def container(frames: list[bytes], md5: bytes) -> bytes:
    """A FLAC file of these frames."""
    sizes = [len(f) for f in frames] or [0]
    points, at = [], 0
    for i, size in enumerate(sizes[: len(frames)]):
        if i % SEEK_EVERY == 0:
            points.append(struct.pack(">QQH", i * BLOCK, at, BLOCK))
        at += size
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | len(frames) * BLOCK).to_bytes(8, "big") + md5
    seek = b"".join(points)
    out = b"fLaC" + (b"\x00" if seek else b"\x80") + len(info).to_bytes(3, "big") + info
    if seek:
        out += b"\x83" + len(seek).to_bytes(3, "big") + seek
    return out + b"".join(frames)


@dataclass
class Stream:
    """What a file's metadata says, and where its frames begin."""

    samples: int
    md5: bytes
    audio: int
    points: list[tuple[int, int]]

    @property
    def blocks(self) -> int:
        return self.samples // BLOCK


def parse(media: bytes) -> Stream:
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, last, found, points = 4, False, None, []
    while not last:
        if at + 4 > len(media):
            raise ValueError("truncated metadata")
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if len(body) < size or kind == 0 and size != 34:
            raise ValueError("truncated metadata")
        if kind == 0:
            word = int.from_bytes(body[10:18], "big")
            if struct.unpack(">HH", body[:4]) != (BLOCK, BLOCK) or (word >> 36) & 31 != 7 or (word >> 41) & 7:
                raise ValueError("not mono of 8 bits in blocks of 192")
            found = (word & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            points = [struct.unpack(">QQ", body[i : i + 16]) for i in range(0, size - 17, 18)]
        at += 4 + size
    if not found or found[0] % BLOCK:
        raise ValueError("no usable STREAMINFO")
    return Stream(found[0], found[1], at, points)


def _take(window: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """size (up to 24) bits at bit positions; window has the 32 bits from each byte on."""
    word = window[at >> 3]
    return ((word << (at & 7).astype(np.uint32)) >> (32 - np.asarray(size)).astype(np.uint32)) * (np.asarray(size) > 0)


def decode_frames(data: np.ndarray, begin: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (a row per frame) and the ends of the frames that begin at these bytes of data."""
    n = len(begin)
    padded = np.concatenate((data, np.zeros(_PAD, np.uint8)))
    window = (padded[:-3].astype(np.uint32) << 24) | (padded[1:-2].astype(np.uint32) << 16) | (padded[2:-1].astype(np.uint32) << 8) | padded[3:]
    bits = np.unpackbits(padded)
    index = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    after = np.minimum.accumulate(index[::-1])[::-1]  # the next 1 at or after each bit
    del index, bits
    heads = [_header(int(i)) for i in numbers]
    size = np.array([len(h) for h in heads])
    for length in np.unique(size).tolist():
        some = np.flatnonzero(size == length)
        want = np.frombuffer(b"".join(heads[i] for i in some), np.uint8).reshape(-1, length)
        got = padded[np.minimum(begin[some, None] + np.arange(length), len(padded) - 1)]
        if (bad := (got != want).any(1)).any():
            raise ValueError(f"block {int(numbers[some[bad]][0])}: damaged header")
    pos = (begin + size).astype(np.int64) * 8
    kind = _take(window, pos, 8).astype(np.int64)
    if (kind & 0x81).any():
        raise ValueError("wasted bits or a broken subframe header")
    kind >>= 1
    pos = pos + 8
    x = np.zeros((n, BLOCK), np.int64)
    signed = lambda v, b: (v.astype(np.int64) ^ (1 << (b - 1))) - (1 << (b - 1))
    flat, plain = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    x[flat] = signed(_take(window, pos[flat], 8), 8)[:, None]
    pos[flat] += 8
    if len(plain):
        x[plain] = signed(padded[(pos[plain] >> 3)[:, None] + np.arange(BLOCK)], 8)
        pos[plain] += 8 * BLOCK
    some = np.flatnonzero(kind > 1)
    if len(some):
        what, at = kind[some], pos[some]
        lpc = what >= 32
        order = np.where(lpc, what - 31, what - 8)
        if ((order < 0) | ~lpc & (order > 4)).any():
            raise ValueError("reserved subframe type")
        m, y = len(some), np.zeros((len(some), BLOCK), np.int64)
        for i in range(int(order.max())):
            has = order > i
            y[has, i] = signed(_take(window, at[has], 8), 8)
            at[has] += 8
        coef, shift = np.zeros((m, max(4, int(order.max()))), np.int64), np.zeros(m, np.int64)
        for f, c in enumerate(((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))):
            coef[~lpc & (order == f), : len(c)] = c
        rows = np.flatnonzero(lpc)
        if len(rows):
            bits_each = _take(window, at[rows], 4).astype(np.int64) + 1
            shift[rows] = signed(_take(window, at[rows] + 4, 5), 5)
            at[rows] += 9
            for i in range(int(order[rows].max())):
                has = order[rows] > i
                r, b = rows[has], bits_each[has]
                v = _take(window, at[r], b).astype(np.int64)
                coef[r, i] = np.where(v >> (b - 1) & 1, v - (1 << b), v)
                at[r] += b
        method = _take(window, at, 2).astype(np.int64)
        parts = _take(window, at + 2, 4).astype(np.int64)
        at += 6
        if (method > 1).any() or (BLOCK % (1 << parts)).any():
            raise ValueError("reserved residual coding")
        span, wide = BLOCK >> parts, 4 + method
        k, first, mark = np.zeros(m, np.int64), order.copy(), np.zeros((m, BLOCK), np.int64)
        ks = np.zeros((m, BLOCK), np.int64)
        uneven = bool((parts > 0).any())
        for i in range(BLOCK):
            if i == 0 or uneven:
                new = np.flatnonzero(i % span == 0)
                if len(new):
                    k[new] = _take(window, at[new], wide[new])
                    if (k[new] == (1 << wide[new]) - 1).any():
                        raise ValueError("unencoded partitions aren't supported")
                    at[new] += wide[new]
            if i < int(order.max()):
                here = np.flatnonzero(i >= first)
                stop = after[at[here]].astype(np.int64)
                mark[here, i], ks[here, i] = stop - at[here], k[here]
                at[here] = stop + 1 + k[here]
                y_at = np.zeros(m, np.int64)
                y_at[here] = stop + 1
                ks[:, i] = np.where(i >= first, ks[:, i], 0)
                low = _take(window, y_at[here], k[here]).astype(np.int64)
                z = (mark[here, i] << k[here]) | low
                y[here, i] = (z >> 1) ^ -(z & 1)
                continue
            stop = after[at].astype(np.int64)
            mark[:, i], ks[:, i] = stop - at, k
            at = stop + 1 + k
            y[:, i] = stop + 1
        w = int(order.max())
        low = _take(window, y[:, w:], ks[:, w:]).astype(np.int64)
        z = (mark[:, w:] << ks[:, w:]) | low
        y[:, w:] = (z >> 1) ^ -(z & 1)
        for f in range(1, 5):
            rows = np.flatnonzero(~lpc & (order == f))
            if len(rows):
                part = y[rows]
                for i in range(f, BLOCK):
                    part[:, i] += sum(c * part[:, i - 1 - j] for j, c in enumerate(((1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[f - 1]))
                y[rows] = part
        for o in np.unique(order[lpc]).tolist():
            rows = np.flatnonzero(lpc & (order == o))
            part, c, s = np.ascontiguousarray(y[rows].T), np.ascontiguousarray(coef[rows].T), shift[rows]
            for i in range(o, BLOCK):
                guess = c[0] * part[i - 1]
                for j in range(1, o):
                    guess += c[j] * part[i - 1 - j]
                part[i] += guess >> s
            y[rows] = part.T
        x[some], pos[some] = y, at
    end = (pos + 7) // 8
    span = end - begin
    longest = int(span.max()) if n else 0
    at = end[:, None] - longest + np.arange(longest)
    body = np.where(at >= begin[:, None], padded[np.clip(at, 0, len(padded) - 1)], 0)
    stored = padded[np.minimum(end, len(padded) - 1)].astype(np.uint32) << 8 | padded[np.minimum(end + 1, len(padded) - 1)]
    if (bad := crc16(body) != stored).any():
        raise ValueError(f"block {int(numbers[bad][0])}: frame checksum differs")
    return x, end + 2


def encode(payloads: list[bytes], lpc: int = 2) -> list[bytes]:
    """FLAC files of payloads whose lengths are multiples of BLOCK."""
    counts = [len(p) // BLOCK for p in payloads]
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    frames: list[bytes] = []
    for i in range(0, len(x), SLAB):
        frames += encode_blocks(x[i : i + SLAB].astype(np.int64) - 128, numbers[i : i + SLAB], lpc)
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        out.append(container(frames[at : at + c], hashlib.md5(signed).digest()))
        at += c
    return out


def frame_starts(media: bytes, s: Stream) -> list[int]:
    """Where the frames begin, most likely. Candidates are sync codes followed by the right frame number and a header that
    passes its CRC-8; each search goes on from the one before."""
    starts, at = [], s.audio
    for i in range(s.blocks):
        at = media.find(_header(i), at)
        if at < 0:
            raise ValueError(f"block {i}: no frame header")
        starts.append(at)
        at += 8
    return starts


def _one_by_one(media: bytes, at: int, first: int, count: int) -> tuple[np.ndarray, int]:
    """Samples of count frames from byte at on, each beginning where the one before ends, and the end of the last."""
    rows = []
    for i in range(first, first + count):
        piece = np.frombuffer(media[at : at + 8 * BLOCK + 64], np.uint8)
        try:
            x, end = decode_frames(piece, np.zeros(1, np.int64), np.array([i]))
        except IndexError:  # codes that go on behind the data
            raise ValueError(f"block {i}: truncated") from None
        if end[0] > len(piece):
            raise ValueError(f"block {i}: truncated")
        at += int(end[0])
        rows.append(x)
    return np.concatenate(rows) if rows else np.zeros((0, BLOCK), np.int64), at


def _side_by_side(media: list[bytes], streams: list[Stream]) -> np.ndarray:
    """The samples of all blocks of all files, frames found by their headers."""
    base, begin, numbers, ends = 0, [], [], []
    for m, s in zip(media, streams, strict=True):
        own = frame_starts(m, s)
        begin += [base + b for b in own]
        base += len(m)
        ends += [*begin[len(begin) - len(own) + 1 :], base] if own else []
        numbers += range(s.blocks)
    data = np.frombuffer(b"".join(media), np.uint8)
    begin_a, number_a, end_a, blocks = np.array(begin, np.int64), np.array(numbers, np.int64), np.array(ends, np.int64), []
    for i in range(0, len(begin_a), SLAB):
        j = min(len(begin_a), i + SLAB)
        lo = int(begin_a[i])
        x, end = decode_frames(data[lo : int(end_a[j - 1])], begin_a[i:j] - lo, number_a[i:j])
        if (end != end_a[i:j] - lo).any():
            raise ValueError("a frame doesn't end where the next begins")
        blocks.append(x)
    return np.concatenate(blocks) if blocks else np.zeros((0, BLOCK), np.int64)


def decode(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each file, as uint8 (sample + 128), checksums verified."""
    streams = [parse(m) for m in media]
    try:
        x = _side_by_side(media, streams)
    except (ValueError, IndexError):  # damage, or a header's look-alike
        parts = []
        for m, s in zip(media, streams, strict=True):
            rows, end = _one_by_one(m, s.audio, 0, s.blocks)
            if end != len(m):
                raise ValueError("bytes after the last frame") from None
            parts.append(rows)
        x = np.concatenate(parts)
    x, out, at = (x + 128).astype(np.uint8), [], 0
    for s in streams:
        pcm = x[at : at + s.blocks].reshape(-1)
        at += s.blocks
        if hashlib.md5((pcm ^ 128).tobytes()).digest() != s.md5:
            raise ValueError("MD5 of the samples differs")
        out.append(pcm)
    return out


def seek_many(media: list[bytes], samples: list[int], count: int) -> list[bytes]:
    """From each file count samples from its given one on. Only the blocks from the nearest seek point on are read; the blocks
    of all files are decoded side by side."""
    pieces, begin, numbers, spans, base, whole = [], [], [], [], 0, []
    for m, sample in zip(media, samples, strict=True):
        s = parse(m)
        first, last = sample // BLOCK, min(s.blocks - 1, (sample + count - 1) // BLOCK)
        point = max((p for p in s.points if p[0] // BLOCK <= first), default=(0, 0))
        start = s.audio + point[1]
        whole.append((start, point[0] // BLOCK, first, last))
        at = start
        for i in range(point[0] // BLOCK, first):
            at = m.find(_header(i + 1), at + 8)
        start = at
        for i in range(first, last + 1):
            begin.append(base + at - start)
            numbers.append(i)
            at = m.find(_header(i + 1), at + 8) if i + 1 < s.blocks else len(m)
        pieces.append(m[start:at])
        spans.append((last + 1 - first, sample - first * BLOCK))
        base += at - start
    try:
        x, _ = decode_frames(np.frombuffer(b"".join(pieces), np.uint8), np.array(begin, np.int64), np.array(numbers, np.int64))
    except (ValueError, IndexError):
        x = np.concatenate([_one_by_one(m, at, point, last + 1 - point)[0][first - point :] for m, (at, point, first, last) in zip(media, whole, strict=True)])
    x, out, row = (x + 128).astype(np.uint8), [], 0
    for rows, skip in spans:
        out.append(x[row : row + rows].reshape(-1)[skip : skip + count].tobytes())
        row += rows
    return out


def seek(media: bytes, sample: int, count: int) -> bytes:
    return seek_many([media], [sample], count)[0]


#: FLAC blocks in one block of PCM.
PER_BLOCK = 16


def written(media: list[bytes], per_block: int = PER_BLOCK) -> Iterator[list[tuple[int, bytes]]]:
    """For each file its blocks of PCM: (sample offset, samples)."""
    step = per_block * BLOCK
    for pcm in decode(media):
        yield [(at, pcm[at : at + step].tobytes()) for at in range(0, len(pcm), step)]


def payload(text: bytes) -> bytes:
    """text with spaces up to a positive multiple of BLOCK."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def add_media(df: DataFrame, text_col: str, media_col: str = "media", bytes_col: str = "n_bytes", lpc: int = 2) -> DataFrame:
    """df with the FLAC file of each text's padded UTF-8 bytes, and the bytes before padding."""
    text_batches(df.sparkSession)
    at = df.columns.index(text_col)
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in (media_col.lower(), bytes_col.lower())]
    names = [df.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(at))
            for i, j in _groups(np.diff(offsets)):
                texts = [data[offsets[x] : offsets[x + 1]].tobytes() for x in range(i, j)]
                made = encode([payload(t) for t in texts], lpc)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(made, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, media_col, bytes_col])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in (df.schema[i] for i in kept))
    return df.mapInArrow(lean(run), f"{schema}`{media_col}` binary, `{bytes_col}` long")


def _groups(sizes: np.ndarray, most: int = SLAB * BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes together."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        yield i, j
        i = j


def pcm_blocks(df: DataFrame, id_col: str, media_col: str = "media", per_block: int = PER_BLOCK) -> DataFrame:
    """Rows (id, sample_offset, samples, pcm) of up to per_block FLAC blocks each: sorted or bucketed by
    (id, sample_offset), a reader finds any sample without decoding."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(whole.column(1).is_valid())
            media = batch.column(1).to_pylist()
            for i, j in _groups(np.array([len(m) for m in media])):
                found = list(written(media[i:j], per_block))
                ids = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), [len(f) for f in found])))
                at, pcm = ([b[k] for f in found for b in f] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int64()), pa.array([len(p) for p in pcm], pa.int32()), pa.array(pcm, pa.binary())], names=["id", "sample_offset", "samples", "pcm"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{media_col}`")).mapInArrow(lean(run), f"id {kind}, sample_offset long, samples int, pcm binary")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks int, last_offset long"


def features(df: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """keep, and what the stored bytes hold once decoded and verified: digests, the CRC of the last 16 samples (found by
    seeking), a feature text (blocks, mean, root mean square and zero crossings), the number of PCM blocks as pcm_blocks()
    writes them and the sample offset of the last. Digests and features run over those blocks in their order."""
    text_batches(df.sparkSession)
    kinds = [x.split() for x in _FEATURES.split(", ")]
    names = results(keep, *(n for n, _ in kinds))

    def told(m: bytes, blocks: list[tuple[int, bytes]], tail: bytes) -> tuple:
        digest, total, squares, crossings, samples, last = hashlib.sha256(), 0, 0, 0, 0, None
        for at, pcm in blocks:
            if at != samples:
                raise ValueError(f"sample {samples}: no block of PCM begins here")
            digest.update(pcm)
            v = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
            total, squares, samples = total + int(v.sum()), squares + int((v * v).sum()), samples + len(pcm)
            low = v < 0
            crossings += int((low[1:] != low[:-1]).sum()) + (last is not None and last != bool(low[0]))
            last = bool(low[-1])
        n = max(1, samples)
        said = f"blocks={samples // BLOCK};mean={total / n:.4f};rms={(squares / n) ** 0.5:.4f};crossings={crossings}"
        return samples, digest.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), said, len(blocks), blocks[-1][0] if blocks else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for batch in batches:
            media = batch.column(len(keep)).to_pylist()
            for i, j in _groups(np.array([len(m or b"") for m in media])):
                part = [m for m in media[i:j] if m is not None]
                blocks = list(written(part))
                tails = seek_many(part, [max(0, b[-1][0] + len(b[-1][1]) - 16) if b else 0 for b in blocks], 16) if part else []
                rows = map(told, part, blocks, tails)
                cols = list(zip(*[(None,) * len(kinds) if m is None else next(rows) for m in media[i:j]], strict=True))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[: len(keep)], *(pa.array(c, types[k]) for c, (_, k) in zip(cols, kinds, strict=True))], names=[*keep, *names])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    made = ", ".join(f"`{n}` {k}" for n, (_, k) in zip(names, kinds, strict=True))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{media_col}`")).mapInArrow(lean(run), schema + made)
