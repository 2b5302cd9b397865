"""Helpers that several corpus operators share: Arrow slices of whole texts and vectorised tokenising."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step takes at once; a longer text forms a step of its own.
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of [^\x20\x09-\x0D].
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offset of each text and of the end. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cuts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold at most ``most`` bytes together, or one longer text."""
    _, offsets = utf8(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def give_back_memory() -> None:
    """Return freed memory to the system, so that a reused worker does not hold its last task's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_texts(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]],
    text: str = "text",
    keep: list[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Append ``fields`` that a vectorised function computes from whole texts, slice by slice.

    ``make()`` runs once in a task and gives ``f(bytes, offsets, is_null) -> arrays``. ``keep`` names the
    columns carried along (all if None); they travel in one struct, so their names cannot clash with
    ``fields`` until the end, where a carried column of the same name gives way. No shuffle.
    """
    carried = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in fields}]
    order = [c for c in carried if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in order]) if order else F.struct(F.lit(0).alias("_"))
    packed = df.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    with_text = text in carried
    head = [packed.schema["row"]] + ([packed.schema["text"]] if with_text else [])
    named = [T.StructField(f"new{i}", f.dataType, True) for i, f in enumerate(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in cuts(texts, slice_bytes):
                part = batch.slice(lo, hi - lo)
                data, offsets = utf8(part.column(1))
                null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                made = f(data, offsets, null)
                cols = [part.column(0)] + ([part.column(1)] if with_text else []) + made
                yield pa.RecordBatch.from_arrays(cols, names=[h.name for h in head] + [x.name for x in named])
        give_back_memory()

    out = packed.mapInArrow(run, T.StructType(head + named))
    back = [F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in carried]
    return out.select(*back, *[F.col(n.name).alias(f.name) for n, f in zip(named, fields)])


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``kind``, and the number of the first word of each text."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 64), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _POWERS = np.cumprod(base, dtype=np.uint64)
    return _POWERS


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased (A-Z) word; equal words have equal hashes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(first[-1] + lens[-1])) - np.repeat(first, lens)
    at = within + np.repeat(starts, lens)
    value = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[within]
    h = np.add.reduceat(value, first) + lens.astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def word_hash(word: bytes) -> int:
    """``hash_words`` of a single word."""
    data = np.frombuffer(word, np.uint8)
    return int(hash_words(data, np.array([0]), np.array([len(data)]))[0])


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code point offsets of the byte offsets ``at`` in one text."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return lead[at]
