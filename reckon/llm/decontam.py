"""Benchmark decontamination by an FM-index over each shard of training texts.

Each task cuts its rows into shards of whole texts and indexes every shard once: words become symbols of
the benchmark's alphabet, a word foreign to it acts as a separator, suffixes are sorted, and the
Burrows-Wheeler transform is kept in a wavelet tree stored level by level. All benchmark windows are then
searched backwards at once; occurrences are located by walking to sampled suffix positions, and the
covered words are merged into removal spans. Nothing is shuffled. The benchmark travels as broadcast
blocks of at most ``block_bytes`` of text; a larger benchmark takes several blocks, one pass each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm.common import ALNUM, code_points, find_words, hash_words, map_texts

WINDOW = 13
SHARD_BYTES = 3 << 20
SAMPLE_RATE = 8
BLOCK_BYTES = 32 << 20

#: A merged range of covered words, and the code points that it takes.
SPAN = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "last", "start", "end")])
SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in SPAN.names]))


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions of ``text`` in suffix order. Symbol 0 separates: its occurrences differ, earlier ones first.

    The first sort compares as many symbols as fit in one integer; only suffixes that still tie are sorted
    again, by the rank of the suffix behind what was compared, so the compared length doubles each time.
    """
    n = len(text)
    take = max(1, 62 // bits)
    alive = text != 0
    key = text.astype(np.int64) << (bits * (take - 1))
    for j in range(1, take):
        ahead = np.zeros(n, np.int64)
        ahead[: n - j] = text[j:] if j < n else 0
        ahead *= alive
        alive &= ahead != 0
        key |= ahead << (bits * (take - 1 - j))
    order = np.argsort(key)
    by_key = key[order]
    new = np.ones(n, bool)
    new[1:] = by_key[1:] != by_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    step = take
    while len(slots):
        pos = order[slots]
        ended = ~alive[pos]
        second = np.where(ended, pos, rank[np.minimum(pos + step, n - 1)])
        composite = rank[pos] * n + second
        again = np.argsort(composite)
        pos, composite = pos[again], composite[again]
        order[slots] = pos
        new = np.ones(len(slots), bool)
        new[1:] = composite[1:] != composite[:-1]
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        step *= 2
    return order


class FMIndex:
    """Count and locate words sequences in one shard. ``text`` holds symbols 1..sigma and separators 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample_rate: int = SAMPLE_RATE):
        n = len(text)
        self.bits = max(1, int(sigma).bit_length())
        order = suffix_order(text, self.bits)
        counts = np.bincount(text, minlength=sigma + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        bwt = text[order - 1]
        self.levels, self.zeros = [], []
        now = bwt
        for level in range(self.bits):
            bit = (now >> (self.bits - 1 - level)) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(n - int(ones[-1]))
            high = bit.astype(bool)
            now = np.concatenate([now[~high], now[high]])
        self.node = np.zeros(sigma + 1, np.int64)
        self.node = self._descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        # positions a whole number of sample_rate symbols behind their run's start are sampled, so that a
        # walk towards the left always meets one before it meets a separator
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(text == 0, at + 1, 0))
        start = np.concatenate([[0], start[:-1]])
        marked = ((at - start) % sample_rate == 0)[order]
        self.marked = marked
        self.sample_rank = np.cumsum(marked) - marked
        self.sample = order[marked]

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self.levels[level][i]
            high = (symbol >> (self.bits - 1 - level)) & 1
            i = np.where(high == 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before row ``i`` of the transform."""
        return self._descend(symbol, i) - self.node[symbol]

    def step(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer to the left."""
        i, symbol = row, np.zeros(len(row), np.int64)
        for level in range(self.bits):
            ones = self.levels[level]
            here = ones[i]
            high = ones[i + 1] - here
            symbol = symbol * 2 + high
            i = np.where(high == 1, self.zeros[level] + here, i - here)
        return self.first[symbol] + i - self.node[symbol]

    def search(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of many patterns ``symbols[start : start + length]``, searched from the right."""
        lo = np.zeros(len(start), np.int64)
        hi = np.zeros(len(start), np.int64)
        live = np.flatnonzero(length > 0)
        last = symbols[start[live] + length[live] - 1]
        lo[live], hi[live] = self.first[last], self.first[last + 1]
        live = live[lo[live] < hi[live]]
        for back in range(2, int(length.max(initial=0)) + 1):
            go = live[length[live] >= back]
            if not len(go):
                break
            symbol = symbols[start[go] + length[go] - back]
            lo[go] = self.first[symbol] + self.rank(symbol, lo[go])
            hi[go] = self.first[symbol] + self.rank(symbol, hi[go])
            live = live[lo[live] < hi[live]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out = np.empty(len(rows), np.int64)
        todo, row, walked = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.marked[row]
            out[todo[hit]] = self.sample[self.sample_rank[row[hit]]] + walked
            todo, row = todo[~hit], self.step(row[~hit])
            walked += 1
        return out


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), and the number of the range that each comes from."""
    size = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


class Phrases:
    """The windows of a block of benchmark items, as symbols of the block's own alphabet."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        blob = b"\0".join(text.encode("utf-8", "surrogatepass") for _, text in items)
        sizes = np.array([len(text.encode("utf-8", "surrogatepass")) for _, text in items], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(blob + b"\0", np.uint8)
        starts, ends, first = find_words(data, offsets, ALNUM)
        hashes = hash_words(data, starts, ends)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        self.symbols = (symbols + 1).astype(np.int64)
        n_words = np.diff(first)
        length = np.minimum(n_words, window)
        begin, of = spread(first[:-1], np.where(n_words > 0, first[:-1] + n_words - length + 1, first[:-1]))
        length = length[of]
        item = np.array([number[name] for name, _ in items], np.int64)[of]
        # equal windows are searched once; items_of lists the items that hold each
        padded = np.zeros((len(begin), window), np.int64)
        for j in range(window):
            has = length > j
            padded[has, j] = self.symbols[begin[has] + j]
        if len(begin):
            _, keep, same = np.unique(padded, axis=0, return_index=True, return_inverse=True)
            same = same.ravel()
        else:
            keep = same = np.zeros(0, np.int64)
        self.start, self.length = begin[keep], length[keep]
        pair = np.unique(same * max(1, len(self.names)) + item)
        self.item = pair % max(1, len(self.names))
        self.item_at = np.searchsorted(pair // max(1, len(self.names)), np.arange(len(keep) + 1))
        # a hash table of the alphabet by leading bits, for words met in texts
        self.table_bits = max(10, int(len(self.vocabulary) * 8).bit_length())
        leading = self.vocabulary >> np.uint64(64 - self.table_bits)
        self.bucket = np.searchsorted(leading, np.arange((1 << self.table_bits) + 1, dtype=np.uint64))

    def symbol_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        key = (hashes >> np.uint64(64 - self.table_bits)).astype(np.int64)
        at, end = self.bucket[key], self.bucket[key + 1]
        out = np.zeros(len(hashes), np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.vocabulary[at[todo]] == hashes[todo]
            out[todo[same]] = at[todo[same]] + 1
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


def scan_shard(data: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> dict:
    """Words of each text, the merged covered word ranges, and the distinct (text, item) pairs of one shard."""
    starts, ends, first = find_words(data, offsets, ALNUM)
    n = len(starts)
    symbol = phrases.symbol_of(hash_words(data, starts, ends))
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    known = np.flatnonzero(symbol)
    covered = np.zeros(n + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    if len(known) and len(phrases.start):
        fresh = np.ones(len(known), bool)
        fresh[1:] = (np.diff(known) > 1) | (text_of[known[1:]] != text_of[known[:-1]])
        place = np.arange(len(known)) + np.cumsum(fresh) - 1
        text = np.zeros(int(place[-1]) + 2, np.int32)
        text[place] = symbol[known]
        word_at = np.zeros(len(text), np.int64)
        word_at[place] = known
        index = FMIndex(text, len(phrases.vocabulary))
        lo, hi = index.search(phrases.symbols, phrases.start, phrases.length)
        rows, window = spread(lo, hi)
        if len(rows):
            begin = word_at[index.locate(rows)]
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + phrases.length[window], -1)
            met = np.unique(text_of[begin] * len(phrases.start) + window)
            met_text, met_window = met // len(phrases.start), met % len(phrases.start)
            at, of = spread(phrases.item_at[met_window], phrases.item_at[met_window + 1])
            both = np.unique(met_text[of] * len(phrases.names) + phrases.item[at])
            pairs = np.stack([both // len(phrases.names), both % len(phrases.names)], 1)
    return {"starts": starts, "ends": ends, "first": first, "hit": np.cumsum(covered[:-1]) > 0, "pairs": pairs}


def _scan(phrases: Phrases):
    def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        got = scan_shard(data, offsets, phrases)
        first, hit = got["first"], got["hit"]
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[first[1:]] - total[first[:-1]]
        spans: list[list[dict]] = [[] for _ in n_hit]
        for i in np.flatnonzero(n_hit):
            mine = np.concatenate([[False], hit[first[i] : first[i + 1]], [False]])
            turn = np.flatnonzero(mine[1:] != mine[:-1])
            begin, end = turn[0::2], turn[1::2]
            at = np.stack([got["starts"][first[i] + begin], got["ends"][first[i] + end - 1]]) - offsets[i]
            at = code_points(data[offsets[i] : offsets[i + 1]], at)
            spans[i] = [dict(zip(("first", "last", "start", "end"), map(int, x))) for x in zip(begin, end, *at)]
        items: list[list[str]] = [[] for _ in n_hit]
        for i, k in got["pairs"]:
            items[i].append(phrases.names[k])
        return [pa.array(np.diff(first), pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]

    return f


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, str]]]:
    """The benchmark's items, in as many blocks as keep each below ``block_bytes`` of text (or one item)."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield [(r.item, r.text) for r in part.distinct().collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append to each document what the benchmark's windows hit in its whole text.

    Columns: ``n_words``, ``n_hit`` (words inside any occurrence of a 13-word window, or of a whole shorter
    item), ``n_items``, ``items`` (ids as sorted strings), ``contaminated`` (at least one word in twenty is
    hit) and ``spans`` (merged removal spans, start and end in code points). Null and empty texts have no
    words and are clean; an item without words, or a null one, has no window; a null item id counts as the
    empty string; repeated item ids count once; an empty benchmark leaves every document clean. Columns of
    the same name give way to the new ones.
    """
    out = docs
    sc = docs.sparkSession.sparkContext
    carried = [c for c in (docs.columns if keep is None else keep)]
    n_blocks = 0
    for block in _blocks(benchmark, block_bytes):
        sent = sc.broadcast(Phrases(block))
        k = n_blocks
        fields = [
            T.StructField(f"__n{k}", T.LongType()),
            T.StructField(f"__s{k}", T.ArrayType(SPAN)),
            T.StructField(f"__i{k}", T.ArrayType(T.StringType())),
        ]
        wanted = carried + ([] if "text" in carried else ["text"]) + [f"__{c}{j}" for j in range(k) for c in "nsi"]
        out = map_texts(out, fields, lambda sent=sent: _scan(sent.value), keep=wanted, slice_bytes=SHARD_BYTES)
        n_blocks += 1
    spans, items = F.col("__s0"), F.col("__i0")
    if n_blocks > 1:
        spans = merge_ranges(F.concat(*[F.col(f"__s{j}") for j in range(n_blocks)]))
        items = F.array_distinct(F.concat(*[F.col(f"__i{j}") for j in range(n_blocks)]))
    base = [c for c in carried if c not in ("n_words", "n_hit", "n_items", "items", "contaminated", "spans")]
    out = out.select(*[F.col(f"`{c}`") for c in base], F.col("__n0").alias("n_words"), F.array_sort(items).alias("items"), spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, q: s + q["last"] - q["first"])
    return out.select(
        *[F.col(f"`{c}`") for c in base], "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        F.transform("spans", lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end"))).alias("spans"),
    )


def merge_ranges(ranges):
    """Unite overlapping or adjacent word ranges of an array of SPAN."""

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
        )
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))
        return F.when((F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["last"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(T.ArrayType(SPAN)), add)
