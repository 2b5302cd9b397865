"""Media columns: texts as 8-bit FLAC streams, written and read by vectorised frame codecs.

A stream has 1024-sample frames, each predicted by a constant, nothing (verbatim), a fixed polynomial or a
quantised linear predictor of order 8, whichever takes fewest bits, with Rice-coded residuals. Frames of
many streams are coded side by side: a step handles the same sample of up to ``ABREAST`` frames, so memory
stays bounded however long a text is. Reading finds frames by their sync code and header checksum, verifies
the frame checksum and the stream's MD5, and yields PCM blocks with their sample offsets. Where data look like
the next header, a frame's checksum is wrong; that stream is then parted at checksums. Any range of samples is
read through the seek table, from the frame at or before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm.common import map_texts

BLOCK = 1024
ORDER = 8
PRECISION = 12
ABREAST = 1024
SEEK_EVERY = 8
PAD = 64
RATE = 8000
#: Fixed predictors of order 0 to 4.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _table(bits: int, poly: int) -> np.ndarray:
    out = np.zeros(256, np.int64)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        crc = i << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        out[i] = crc
    return out


_CRC8 = _table(8, 0x07).tolist()
_CRC16 = _table(16, 0x8005)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Checksums of many byte ranges at once, a step for each byte of the longest."""
    order = np.argsort(starts - ends, kind="stable")
    at, size = starts[order], (ends - starts)[order]
    crc = np.zeros(len(order), np.int64)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left") if longest else []
    for t in range(longest):
        n = live[t]
        c = crc[:n]
        crc[:n] = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ buf[at[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """The extended UTF-8 code of a frame number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        if n < 1 << (6 - len(tail)):
            lead = (0xFF << (7 - len(tail))) & 0xFF
            return bytes([lead | n, *reversed(tail)])


def frame_header(number: int, size: int) -> bytes:
    head = b"\xff\xf8" + bytes([0xA4 if size == BLOCK else 0x74, 0x02]) + _utf8_number(number)
    if size != BLOCK:
        head += struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


def _predictors(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors [F, ORDER] of each row and their shifts, by Levinson's recursion."""
    lag = np.stack([(x[:, j:] * x[:, : x.shape[1] - j]).sum(axis=1) for j in range(ORDER + 1)], axis=1).astype(np.float64)
    lag[:, 0] = lag[:, 0] * 1.000001 + 1e-3
    n = len(x)
    a, error = np.zeros((n, ORDER)), lag[:, 0].copy()
    for i in range(ORDER):
        k = (lag[:, i + 1] - (a[:, :i] * lag[:, i:0:-1]).sum(axis=1)) / error
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a = new
        error *= np.maximum(1 - k * k, 1e-9)
    most = np.abs(a).max(axis=1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(most, 1e-6))).astype(np.int64), 0, 14)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (2.0 ** shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x less its prediction from the samples before, at each place with a full history."""
    total = np.zeros_like(x)
    for j in range(coefs.shape[1]):
        total[:, j + 1 :] += coefs[:, j : j + 1] * x[:, : x.shape[1] - j - 1]
    total >>= shift[:, None]
    return x - total


def encode_frames(x: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames of the rows of x [F, BLOCK] (int64, -128..127), of which row f counts its first size[f] samples."""
    n = len(x)
    inside = np.arange(BLOCK)[None] < size[:, None]
    at = np.arange(n)
    best_bits = 8 * size  # verbatim
    best = np.full(n, 1)
    order, shift = np.zeros(n, np.int64), np.zeros(n, np.int64)
    coefs, rice, zig = np.zeros((n, ORDER), np.int64), np.zeros(n, np.int64), np.zeros((n, BLOCK), np.int32)
    x = np.where(inside, x, 0).astype(np.int32)
    c, s = _predictors(x, size)
    # of the fixed predictors the one of least residual; each order is the difference of the one before
    differences, r = [x], x
    for _ in range(4):
        r = np.diff(r, axis=1, prepend=0).astype(np.int32)
        differences.append(r)
    loss = np.stack([np.where(inside, np.abs(d), 0)[:, p:].sum(axis=1) + 64 * p for p, d in enumerate(differences)], axis=1)
    fixed = loss.argmin(axis=1)
    plain = np.stack(differences)[fixed, at]
    full = np.full(n, ORDER)
    for kind, p, residual in ((8 + fixed, fixed, plain), (np.full(n, 32 + ORDER - 1), full, _residual(x, c.astype(np.int32), s.astype(np.int32)))):
        z = np.where(inside & (np.arange(BLOCK)[None] >= p[:, None]), (residual << 1) ^ (residual >> 31), 0)
        coded = size - p
        guess = np.log2(np.maximum(z.sum(axis=1) / np.maximum(coded, 1), 1)).astype(np.int64)
        tries = [np.clip(guess + step, 0, 14) for step in (-1, 0, 1)]
        costs = np.stack([(z >> k[:, None].astype(np.int32)).sum(axis=1) + coded * (1 + k) for k in tries], axis=1)
        k = np.stack(tries, axis=1)[at, costs.argmin(axis=1)]
        total = costs.min(axis=1) + 8 * p + 10 + np.where(kind >= 32, 9 + PRECISION * p, 0)
        win = total < best_bits
        best_bits = np.where(win, total, best_bits)
        best[win], order[win], rice[win] = kind[win], p[win], k[win]
        zig[win] = z[win]
    lpc_won = best >= 32
    coefs[lpc_won], shift[lpc_won] = c[lpc_won], s[lpc_won]
    flat = np.where(inside, x, x[:, :1]) == x[:, :1]
    same = flat.all(axis=1)
    best[same], best_bits[same], order[same] = 0, 8, 0
    heads = [frame_header(int(i), int(m)) for i, m in zip(number, size)]
    head = np.array([len(h) for h in heads])
    body = -(-best_bits // 8) + 1  # with the subframe's header
    length = head + body + 2
    begin = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, np.uint8)
    put = lambda at, value, width: [bits.__setitem__(at + j, (value >> (width - 1 - j)) & 1) for j in range(width)]
    sub = (begin + head) * 8
    put(sub, best << 1, 8)
    byte = x & 0xFF
    put(sub[same] + 8, byte[same, 0], 8)
    coded = np.flatnonzero(best >= 8)
    for p in range(ORDER):
        has = coded[order[coded] > p]
        put(sub[has] + 8 + 8 * p, byte[has, p], 8)
    at = sub[coded] + 8 + 8 * order[coded]
    lpc = best[coded] >= 32
    put(at[lpc], np.full(lpc.sum(), PRECISION - 1), 4)
    put(at[lpc] + 4, shift[coded[lpc]], 5)
    for j in range(ORDER):
        put(at[lpc] + 9 + PRECISION * j, coefs[coded[lpc], j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + np.where(lpc, 9 + PRECISION * ORDER, 0)
    put(at + 6, rice[coded], 4)  # method 0, one partition
    if len(coded):
        k = rice[coded][:, None]
        live = inside[coded] & (np.arange(BLOCK)[None] >= order[coded][:, None])
        q = zig[coded] >> k
        width = np.where(live, q + 1 + k, 0)
        stop = (at + 10)[:, None] + np.cumsum(width, axis=1) - width + q
        stop, z, kk = stop[live], zig[coded][live], np.broadcast_to(k, live.shape)[live]
        bits[stop] = 1
        for j in range(int(k.max())):
            has = kk > j
            bits[stop[has] + 1 + j] = (z[has] >> (kk[has] - 1 - j)) & 1
    out = np.packbits(bits)
    for f in range(n):
        b = begin[f]
        out[b : b + head[f]] = np.frombuffer(heads[f], np.uint8)
        if best[f] == 1:
            out[b + head[f] + 1 : b + head[f] + 1 + size[f]] = byte[f, : size[f]]
    sums = crc16(out, begin, begin + length - 2)
    out[begin + length - 2], out[begin + length - 1] = sums >> 8, sums & 0xFF
    raw = out.tobytes()
    return [raw[b:e] for b, e in zip(begin.tolist(), (begin + length).tolist())]


def encode_streams(payloads: list[np.ndarray]) -> list[bytes]:
    """A FLAC stream for each array of bytes; byte b is the sample b - 128."""
    size, number, parts, owner = [], [], [], []
    for i, p in enumerate(payloads):
        for j in range(0, len(p), BLOCK):
            parts.append(p[j : j + BLOCK])
            number.append(j // BLOCK)
            owner.append(i)
    frames: list[bytes] = []
    for lo in range(0, len(parts), ABREAST):
        chunk = parts[lo : lo + ABREAST]
        size = np.array([len(c) for c in chunk])
        x = np.zeros((len(chunk), BLOCK), np.int64)
        for f, c in enumerate(chunk):
            x[f, : len(c)] = c
        x -= 128
        frames += encode_frames(x, size, np.array(number[lo : lo + ABREAST]))
    out: list[bytes] = []
    at = 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        mine = frames[at : at + n]
        at += n
        sizes = [len(m) for m in mine]
        offset = np.cumsum([0, *sizes])
        seek = b"".join(struct.pack(">QQH", j * BLOCK, offset[j], min(BLOCK, len(p) - j * BLOCK)) for j in range(0, n, SEEK_EVERY))
        md5 = hashlib.md5((p ^ 0x80).tobytes()).digest()
        packed = (RATE << 44) | (7 << 36) | len(p)  # rate, one channel, eight bits, number of samples
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(mine))
    return out


def _parse_header(buf: bytes, at: int) -> tuple[int, int, int] | None:
    """Frame number, samples and header length of a mono 8-bit frame header at ``at``; None if there is none."""
    if buf[at : at + 2] != b"\xff\xf8" or len(buf) < at + 8 or buf[at + 3] != 0x02 or buf[at + 2] not in (0xA4, 0x74):
        return None
    lead = buf[at + 4]
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if extra < 0 or lead == 0xFF or 0x80 <= lead < 0xC0:
        return None
    number = lead if extra == 0 else lead & (0x3F >> extra)
    for b in buf[at + 5 : at + 5 + extra]:
        number = number << 6 | (b & 0x3F)
    end = at + 5 + extra
    size = BLOCK
    if buf[at + 2] == 0x74:
        size = int.from_bytes(buf[end : end + 2], "big") + 1
        end += 2
    return (number, size, end + 1 - at) if end < len(buf) and crc8(buf[at:end]) == buf[end] else None


def _metadata(buf: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Where the frames start, samples in all, the MD5, and (sample, offset) of the seek points of a stream."""
    if buf[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = buf[at] >> 7, buf[at] & 0x7F, int.from_bytes(buf[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(buf[at + 14 : at + 22], "big") & ((1 << 36) - 1)
            md5 = buf[at + 22 : at + 38]
        elif kind == 3:
            points = [p[:2] for p in struct.iter_unpack(">QQH", buf[at + 4 : at + 4 + size])]
        at += 4 + size
    return at, total, md5, points


def find_frames(buf: bytes, first: int = 0, end: int | None = None, checked: bool = False) -> tuple[list[tuple[int, int, int, int, int]], int, bytes]:
    """(start, end, header length, samples, sample offset) of the frames that hold samples ``first`` to ``end`` of a
    stream, its samples in all, and its MD5. If ``checked``, a frame ends only where its checksum agrees."""
    at, total, md5, points = _metadata(buf)
    stop = total if end is None else end
    near = max((p for p in points if p[0] <= first), default=(0, 0))
    at, place = at + near[1], near[0]
    raw = np.frombuffer(buf, np.uint8)
    out: list[tuple[int, int, int, int, int]] = []
    while at < len(buf) and place < stop:
        head = _parse_header(buf, at)
        if head is None or head[0] != place // BLOCK:
            raise ValueError("a frame's header is wrong")
        close = buf.find(b"\xff\xf8", at + head[2])
        while close >= 0:
            following = _parse_header(buf, close)
            if following and following[0] == head[0] + 1 and not (checked and crc16(raw, np.array([at]), np.array([close])).any()):
                break
            close = buf.find(b"\xff\xf8", close + 1)
        close = close if close >= 0 else len(buf)
        if place + head[1] > first:
            out.append((at, close, head[2], head[1], place))
        at, place = close, place + head[1]
    return out, total, md5


#: Leading zeros of sixteen bits.
_ZEROS = 16 - np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int64)


class _Bits:
    """Reads bit fields at many places of one buffer at once."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate([buf, np.zeros(16, np.uint8)]).astype(np.uint64)
        self.word = np.zeros(len(buf) + 8, np.uint64)
        for j in range(8):
            self.word |= padded[j : j + len(buf) + 8] << np.uint64(56 - 8 * j)

    def head(self, at: np.ndarray) -> np.ndarray:
        return self.word[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned fields of up to 48 bits."""
        width = np.asarray(width)
        return np.where(width > 0, self.head(at) >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Number of zero bits before the next one bit."""
        q = _ZEROS[(self.head(at) >> np.uint64(48)).astype(np.int64)]
        more = np.flatnonzero(q == 16)
        while len(more):
            step = _ZEROS[(self.head(at[more] + q[more]) >> np.uint64(48)).astype(np.int64)]
            q[more] += step
            more = more[step == 16]
        return q

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned Rice codes of parameter k (at most 30): their values and widths."""
        word = self.head(at)
        q = _ZEROS[(word >> np.uint64(48)).astype(np.int64)]
        # the stop bit is shifted out first, then the k bits behind it come down
        low = ((word << (q + 1).astype(np.uint64)) >> np.uint64(34)).astype(np.int64) >> (30 - k)
        far = np.flatnonzero(q == 16)
        if len(far):
            q[far] = self.unary(at[far])
            low[far] = self.take(at[far] + q[far] + 1, k[far])
        return (q << k) | low, q + 1 + k


def decode_frames(buf: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Samples [F, max size] of frames in one buffer, whose checksums the caller has verified."""
    n, longest = len(start), int(size.max(initial=0))
    bits = _Bits(buf)
    at = (start + head) * 8
    kind = bits.take(at, np.full(n, 8)) >> 1
    at = at + 8
    out = np.zeros((longest, n), np.int64)
    signed = lambda v, w: v - ((v >> (w - 1)) << w)
    first = signed(bits.take(at, np.full(n, 8)), 8)
    out[:, kind == 0] = first[kind == 0]
    for f in np.flatnonzero(kind == 1):
        b = at[f] >> 3
        out[: size[f], f] = buf[b : b + size[f]].view(np.int8)
    coded = np.flatnonzero(kind >= 8)
    if not len(coded):
        return out.T
    coded = coded[np.argsort(-size[coded], kind="stable")]  # long frames first: those still live are a prefix
    kind, at, size = kind[coded], at[coded], size[coded]
    order = np.where(kind >= 32, kind - 31, kind - 8)
    most = int(order.max())
    n = len(coded)
    r = np.zeros((longest, n), np.int64)
    for p in range(most):
        has = order > p
        r[p, has] = signed(bits.take(at[has] + 8 * p, np.full(has.sum(), 8)), 8)
    at = at + 8 * order
    coefs, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    lpc = kind >= 32
    precision = np.where(lpc, bits.take(at, np.full(n, 4)) + 1, 0)
    shift[lpc] = signed(bits.take(at + 4, np.full(n, 5)), 5)[lpc]
    for p in range(most):
        has = lpc & (order > p)
        w = precision[has]
        coefs[p, has] = signed(bits.take(at[has] + 9 + w * p, w), w)
        for o, fixed in enumerate(FIXED):
            if o > p:
                coefs[p, ~lpc & (order == o)] = fixed[p]
    at = at + np.where(lpc, 9 + precision * order, 0)
    wide = 4 + bits.take(at, np.full(n, 2))  # method 1 has five-bit parameters
    parts = 1 << bits.take(at + 2, np.full(n, 4))
    at = at + 6
    next_part, per_part = order.copy(), size // parts
    upto = per_part.copy()
    k, raw = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live_rows = np.searchsorted(-size, -np.arange(longest), "left")
    for t in range(longest):
        m = int(live_rows[t])
        live = np.flatnonzero(t >= order[:m]) if t < most else slice(0, m)
        fresh = (next_part == t) & (t < size)
        if fresh.any():
            f = np.flatnonzero(fresh)
            k[f] = bits.take(at[f], wide[f])
            at[f] += wide[f]
            escape = f[k[f] == (1 << wide[f]) - 1]
            raw[f] = 0
            raw[escape] = bits.take(at[escape], np.full(len(escape), 5)) + 1
            at[escape] += 5
            next_part[f] = upto[f]
            upto[f] += per_part[f]
        a, kk = at[live], k[live]
        z, used = bits.rice(a, kk)
        value = (z >> 1) ^ -(z & 1)
        if raw.any():
            esc = raw[live] > 0
            width = raw[live][esc] - 1
            value[esc] = signed(bits.take(a[esc], width), np.maximum(width, 1))
            used[esc] = width
        r[t, live] = value
        at[live] = a + used
    # the history of the first samples is empty: rows of zeros before them
    history = np.concatenate([np.zeros((most, n), np.int64), r])
    turned = coefs[::-1]
    for t in range(1, longest):
        m = int(live_rows[t])
        step = (turned[:, :m] * history[t : t + most, :m]).sum(axis=0) >> shift[:m]
        if t < most:
            step *= t >= order[:m]
        history[t + most, :m] += step
    r = history[most:]
    out[:, coded] = r
    return out.T


def _pieces(streams: list[bytes], jobs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [streams[i][a:b] for i, a, b, *_ in jobs]
    size = np.array([len(p) for p in parts], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(parts), np.uint8), end - size, end


def read_samples(streams: list[bytes], ranges: list[tuple[int, int]] | None = None) -> list[np.ndarray]:
    """The bytes of each stream within its range of samples (all of them if None), by way of the seek table.

    A frame whose checksum is wrong makes its stream be parted anew, at checksums; if that fails too, it raises.
    """
    ranges = ranges or [(0, _metadata(s)[1]) for s in streams]

    def frames(i: int, checked: bool) -> list[tuple]:
        return [(i, *f) for f in find_frames(streams[i], *ranges[i], checked=checked)[0]]

    jobs = [f for i in range(len(streams)) for f in frames(i, False)]
    damaged: set[int] = set()
    for lo in range(0, len(jobs), ABREAST):
        part = jobs[lo : lo + ABREAST]
        damaged |= {part[f][0] for f in np.flatnonzero(crc16(*_pieces(streams, part)))}
    if damaged:
        again = [f for i in sorted(damaged) for f in frames(i, True)]
        if crc16(*_pieces(streams, again)).any():
            raise ValueError("a frame's checksum is wrong")
        jobs = [f for f in jobs if f[0] not in damaged] + again
    out = [np.zeros(max(0, hi - lo), np.uint8) for lo, hi in ranges]
    filled = [0] * len(out)
    for lo in range(0, len(jobs), ABREAST):
        part = jobs[lo : lo + ABREAST]
        buf, start, end = _pieces(streams, part)
        x = decode_frames(buf, start, end, np.array([j[3] for j in part]), np.array([j[4] for j in part]))
        x = (x + 128).astype(np.uint8)
        for f, (i, _, _, _, size, place) in enumerate(part):
            first, last = ranges[i]
            a, b = max(first, place), min(last, place + size)
            out[i][a - first : b - first] = x[f, a - place : b - place]
            filled[i] += max(0, b - a)
    if any(n != len(x) for n, x in zip(filled, out)):
        raise ValueError("a stream's length is wrong")
    return out


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The bytes of each whole stream; wrong checksums, lengths or digests raise."""
    out = read_samples(streams)
    for samples, s in zip(out, streams):
        if hashlib.md5((samples ^ 0x80).tobytes()).digest() != _metadata(s)[2]:
            raise ValueError("a stream's digest is wrong")
    return out


def blocks_of(samples: np.ndarray) -> list[tuple[int, bytes, int]]:
    """(sample offset, PCM bytes, CRC-32) of the blocks of a stream read back."""
    pcm = (samples ^ 0x80).tobytes()
    return [(at, pcm[at : at + BLOCK], zlib.crc32(pcm[at : at + BLOCK])) for at in range(0, len(pcm), BLOCK)]


def payload(data: np.ndarray) -> np.ndarray:
    """The bytes of a text, filled up by zeros to a positive multiple of 64."""
    out = np.zeros(max(PAD, -(-len(data) // PAD) * PAD), np.uint8)
    out[: len(data)] = data
    return out


def feature(samples: np.ndarray) -> str:
    """Length, loudness and zero crossings of a signal read back, as text."""
    x = samples.astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"samples={len(x)};mean={x.mean():.3f};rms={np.sqrt((x * x).mean()):.3f};crossings={crossings};peak={int(np.abs(x).max())}"


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``media``, the FLAC stream of each whole text. Null is empty; an empty text has 64 zero samples."""

    def make():
        def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
            streams = encode_streams([payload(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
            return [pa.array(streams, pa.binary())]

        return f

    return map_texts(docs, [T.StructField("media", T.BinaryType())], make, text=text_col, keep=keep, slice_bytes=1 << 20)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decode streams into rows (id, block, sample_offset, samples, pcm, crc32), one for each frame.

    Any block can be read alone by its offset. A null stream gives no rows; a damaged one raises.
    """
    schema = T.StructType([media.schema[id_col], *(T.StructField(c, t) for c, t in (("block", T.IntegerType()), ("sample_offset", T.LongType()), ("samples", T.IntegerType()), ("pcm", T.BinaryType()), ("crc32", T.LongType())))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stream = batch.column(1)[i].as_py()
                if stream is None:
                    continue
                cut = blocks_of(decode_streams([stream])[0])
                ids = pa.concat_arrays([batch.column(0).slice(i, 1)] * len(cut))
                offset, pcm, crc = zip(*cut)
                cols = [pa.array(range(len(cut)), pa.int32()), pa.array(offset, pa.int64()), pa.array([len(c) for c in pcm], pa.int32()), pa.array(pcm, pa.binary()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=schema.names)

    return media.select(id_col, media_col).mapInArrow(run, schema)


def digest(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Store each text as FLAC, read the stored bytes back, and append digests and a feature of what was read.

    Columns: ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (last 64 bytes, read through the
    seek table), ``media_bytes``, ``media_sha256``, ``feature``, and ``n_blocks`` and ``blocks_sha256``, the number of
    PCM blocks and the digest of their list (offset:samples:crc32, comma-joined). Null and empty texts hold 64 zero bytes. Equal texts
    get equal values; columns of these names give way; an empty table gives no rows.
    """
    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("n_blocks", T.LongType()), ("blocks_sha256", T.StringType())]

    def make():
        def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
            streams = encode_streams([payload(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])])
            back = decode_streams(streams)
            raw = [b.tobytes() for b in back]
            tails = read_samples(streams, [(len(r) - PAD, len(r)) for r in raw])
            blocks = [blocks_of(b) for b in back]
            lists = [",".join(f"{at}:{len(pcm)}:{crc}" for at, pcm, crc in x) for x in blocks]
            return [
                pa.array(np.diff(offsets), pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                pa.array([zlib.crc32(t.tobytes()) for t in tails], pa.int64()), pa.array([len(s) for s in streams], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()), pa.array([feature(b) for b in back], pa.string()), pa.array([len(x) for x in blocks], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists], pa.string()),
            ]

        return f

    return map_texts(docs, [T.StructField(*f) for f in fields], make, text=text_col, keep=keep, slice_bytes=1 << 20)
