import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reckon.llm import flac


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=3000), st.text(max_size=400).map(str.encode)), min_size=1, max_size=5))
def test_round_trip(texts):
    payloads = [flac.payload(np.frombuffer(t, np.uint8)) for t in texts]
    for a, b in zip(payloads, flac.decode_streams(flac.encode_streams(payloads)), strict=True):
        assert np.array_equal(a, b)


def test_kinds_of_frames():
    t = np.arange(5000)
    smooth = (128 + 90 * np.sin(t / 9)).astype(np.uint8)
    rng = np.random.default_rng(0)
    signals = [smooth, np.full(2000, 7, np.uint8), rng.integers(0, 256, 3000).astype(np.uint8), np.tile(np.frombuffer(b"the onth of and ", np.uint8), 200), np.full(200_000, 65, np.uint8)]
    payloads = [flac.payload(s) for s in signals]
    streams = flac.encode_streams(payloads)
    kinds = {s[a + h] >> 1 for s in streams for a, _, h, *_ in flac.find_frames(s)[0]}
    assert {0, 1} <= kinds and any(8 <= k < 32 for k in kinds) and any(k >= 32 for k in kinds)
    assert len(streams[0]) < 0.7 * len(payloads[0])
    for a, b in zip(payloads, flac.decode_streams(streams), strict=True):
        assert np.array_equal(a, b)


def test_damage_is_found():
    stream = bytearray(flac.encode_streams([flac.payload(np.frombuffer(b"some text " * 300, np.uint8))])[0])
    stream[-20] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(stream)])


def test_checksums():
    assert flac.crc8(b"123456789") == 0xF4
    buf = np.frombuffer(b"xx123456789", np.uint8)
    assert flac.crc16(buf, np.array([2, 2]), np.array([11, 2])).tolist() == [0xFEE8, 0]


def test_rows(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "é" * 700, " ".join(rng.choice(["the", "on", "tion"]) for _ in range(30000)), "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in flac.digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(full))
        assert got[i].payload_sha256 == hashlib.sha256(full).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(full[-64:])
        listed = ",".join(f"{at}:{len(full[at : at + 1024])}:{zlib.crc32(bytes(b ^ 0x80 for b in full[at : at + 1024]))}" for at in range(0, len(full), 1024))
        assert (got[i].n_blocks, got[i].blocks_sha256) == (-(-len(full) // 1024), hashlib.sha256(listed.encode()).hexdigest())
    assert got[2][2:] == got[5][2:] and got[0].feature == got[1].feature
    blocks = flac.pcm_blocks(flac.encode(df, keep=["doc_id"])).where("doc_id = 3").orderBy("block").collect()
    assert bytes(b ^ 0x80 for r in blocks for b in r.pcm).rstrip(b"\0") == ("é" * 700).encode()
    assert [r.sample_offset for r in blocks] == [0, 1024]
    assert flac.digest(df.limit(0)).count() == 0


class Plain:
    """A FLAC decoder of mono 8-bit streams that reads bit by bit."""

    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self):
        n = self.bits.index("1", self.at) - self.at
        self.at += n + 1
        return n

    def stream(self):
        assert self.take(32) == int.from_bytes(b"fLaC", "big")
        last, total, points = 0, 0, []
        while not last:
            last, kind, size = self.take(1), self.take(7), self.take(24)
            end = self.at + 8 * size
            if kind == 0:
                self.at += 16 + 16 + 24 + 24 + 20 + 3 + 5
                total = self.take(36)
            elif kind == 3:
                points = [(self.take(64), self.take(64), self.take(16)) for _ in range(size // 18)]
            self.at = end
        begin, out, starts = self.at, [], {}
        while len(out) < total:
            starts[len(out)] = (self.at - begin) // 8
            out += self.frame()
        assert all(starts[s] == o and n == min(1024, total - s) for s, o, n in points)
        return out

    def frame(self):
        assert self.take(14) == 0x3FFE
        self.at += 2
        size_code, _, channels, depth, _ = self.take(4), self.take(4), self.take(4), self.take(3), self.take(1)
        assert channels == 0 and depth == 1
        lead = self.take(8)
        self.at += 8 * max(0, 8 - (lead ^ 0xFF).bit_length() - 1 if lead >= 0x80 else 0)
        n = self.take(16) + 1 if size_code == 7 else 256 << (size_code - 8)
        self.at += 8
        self.at += 1
        kind, wasted = self.take(6), self.take(1)
        assert not wasted
        if kind == 0:
            x = [self.signed(8)] * n
        elif kind == 1:
            x = [self.signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [self.signed(8) for _ in range(order)]
            if kind < 32:
                coefs, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            else:
                precision = self.take(4) + 1
                shift = self.signed(5)
                coefs = [self.signed(precision) for _ in range(order)]
            wide, parts = 4 + self.take(2), 1 << self.take(4)
            for p in range(parts):
                k = self.take(wide)
                raw = self.take(5) if k == (1 << wide) - 1 else None
                for _ in range(n // parts - (order if p == 0 else 0)):
                    if raw is None:
                        z = (self.unary() << k) | self.take(k)
                        e = (z >> 1) ^ -(z & 1)
                    else:
                        e = self.signed(raw)
                    x.append(e + (sum(c * v for c, v in zip(coefs, x[::-1])) >> shift))
        self.at += -self.at % 8 + 16
        return x


def signals():
    rng = np.random.default_rng(4)
    t = np.arange(2500)
    yield (128 + 90 * np.sin(t / 9)).astype(np.uint8)
    yield np.full(2100, 7, np.uint8)
    yield rng.integers(0, 256, 1500).astype(np.uint8)
    yield np.tile(np.frombuffer(b"the onth of and ", np.uint8), 150)
    yield np.frombuffer(("é and some words of a text, " * 40).encode(), np.uint8)
    yield np.zeros(0, np.uint8)
    yield (t // 9 % 256).astype(np.uint8)


def test_a_plain_decoder_reads_the_streams():
    payloads = [flac.payload(s) for s in signals()]
    for p, s in zip(payloads, flac.encode_streams(payloads)):
        assert [v + 128 for v in Plain(s).stream()] == p.tolist()


def test_ranges_are_read_through_the_seek_table():
    rng = random.Random(6)
    payloads = [flac.payload(np.frombuffer(bytes(rng.choices(b"the ontio of", k=n)), np.uint8)) for n in (10, 1024, 9000, 60_000)]
    streams = flac.encode_streams(payloads)
    for _ in range(40):
        ranges = [tuple(sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))) for p in payloads]
        for p, (a, b), x in zip(payloads, ranges, flac.read_samples(streams, ranges)):
            assert np.array_equal(x, p[a:b])
    # only frames from the seek point on are read: damage before it is not met
    spoilt = bytearray(streams[3])
    first = flac.find_frames(streams[3])[0][0]
    spoilt[(first[0] + first[1]) // 2] ^= 1
    assert np.array_equal(flac.read_samples([bytes(spoilt)], [(59_000, 59_500)])[0], payloads[3][59_000:59_500])
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(spoilt)])


def test_data_that_look_like_a_header():
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 256, 3000).astype(np.uint8)
    noise[500:507] = np.frombuffer((flac.frame_header(1, flac.BLOCK) + b"\0")[:7], np.uint8) ^ 0x80
    payloads = [flac.payload(noise), flac.payload(noise[:100])]
    streams = flac.encode_streams(payloads)
    false = flac.find_frames(streams[0])[0]
    assert false[0][1] - false[0][0] < 600 and flac.find_frames(streams[0], checked=True)[0][0][1] - false[0][0] > 1000
    for a, b in zip(payloads, flac.decode_streams(streams)):
        assert np.array_equal(a, b)
