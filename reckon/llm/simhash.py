"""SimHash near-duplicates, linked through BK-trees.

Equal fingerprints are one node, so copies cost nothing beyond the fingerprint itself. Two fingerprints
that differ in at most r bits agree on at least b - r of b bands of bits; each choice of b - r bands and
their value names a tree shard, and every fingerprint goes to all of its shards by one shuffle. A task
builds the BK-trees of its shards (children keyed by their integer distance to the parent), searches each
fingerprint along the edges within the radius, and emits a spanning forest of the links, never all pairs.
Trees reach the queries by that shuffle and not by broadcast, because they grow with the corpus. The
forests of all shards are joined by distributed star contraction.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.durable import drop_stash, stash
from reckon.llm.common import give_back_memory, map_texts
from reckon.operators.components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: (query, node) pairs that a search holds at once.
FRONTIER = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one text: shingles of four words, repeats included, hashed by XXH64."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the separators \x20 \x09-\x0D
    if not words:
        return 0
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= SHINGLE:
        return digest(b" ".join(words), seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    joined = b" ".join(words)
    starts = [0, *ends[:-SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + (1 << 16)].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints():
    def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        body = data.tobytes()
        made = [fingerprint(body[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [pa.array(np.array(made, np.uint64).view(np.int64), pa.int64())]

    return f


def add_fingerprint(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Append ``fp``, the fingerprint as a signed long; null and wordless texts have fingerprint zero."""
    return map_texts(docs, [T.StructField("fp", T.LongType())], _fingerprints, keep=keep)


def bands(radius: int, agree: int) -> list[int]:
    """Masks of ``agree`` whole bands out of ``radius + agree``: of two values within the radius, one mask agrees."""
    n = radius + agree
    edges = [round(64 * i / n) for i in range(n + 1)]
    each = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    return [functools.reduce(int.__or__, pick) for pick in itertools.combinations(each, agree)]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


class Forest:
    """BK-trees of many shards at once, one for each run of equal ``shard`` numbers. Values of a shard differ."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        self.value = value
        self.root = np.searchsorted(shard, shard)  # the first value of each shard is its root
        keys, nodes = [], []
        todo = np.flatnonzero(self.root != np.arange(n))
        parent = self.root[todo]
        while len(todo):
            key = parent * 65 + np.bitwise_count(value[todo] ^ value[parent]).astype(np.int64)
            edge, first, of = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            nodes.append(todo[first])
            child = todo[first][of]
            rest = child != todo
            todo, parent = todo[rest], child[rest]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.edge = key[order]
        self.child = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def near(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of the same shard within the radius, in bounded pieces."""
        stack = [(query[i : i + FRONTIER], self.root[query[i : i + FRONTIER]]) for i in range(0, len(query), FRONTIER)]
        while stack:
            q, node = stack.pop()
            apart = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
            hit = (apart <= radius) & (q > node)
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(apart - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * 65 + np.minimum(apart + radius, 64), "right")
            total = np.cumsum(hi - lo)
            if not len(total) or not total[-1]:
                continue
            start = 0
            while start < len(q):
                base = total[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(total, base + FRONTIER, "right")))
                at, of = _ranges(lo[start:stop], hi[start:stop])
                if len(at):
                    stack.append((q[start:stop][of], self.child[at]))
                start = stop


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite many pairs at once: hook roots to smaller roots and halve paths until nothing changes."""
    while len(a):
        ra, rb = parent[a], parent[b]
        while True:
            up = parent[ra]
            if np.array_equal(up, ra):
                break
            ra = up
        while True:
            up = parent[rb]
            if np.array_equal(up, rb):
                break
            rb = up
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if len(a):
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _links(radius: int):
    """For batches sorted by (mask, shard value): a spanning forest of the links inside each shard."""

    def solve(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        forest = Forest(np.cumsum(new), fp.view(np.uint64))
        parent = np.arange(len(fp))
        for q, node in forest.near(np.arange(len(fp)), radius):
            _join(parent, q, node)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        linked = np.flatnonzero(parent != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[parent[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def columns(parts: list[np.ndarray]) -> np.ndarray:
            return np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)

        for batch in batches:
            now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if not now.shape[1]:
                continue
            # shards that end in this batch can be solved; the last one may go on in the next batch
            last = int(np.flatnonzero((now[:2] != now[:2, -1:]).any(axis=0))[-1]) + 1 if (now[:2] != now[:2, -1:]).any() else 0
            same = held and (held[-1][:2, -1] == now[:2, 0]).all()
            if last or not same:
                yield solve(*columns([*held, now[:, :last]]))
                held = []
            held.append(now[:, last:])
        if held:
            yield solve(*columns(held))
        give_back_memory()

    return run


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, agree: int = 1) -> DataFrame:
    """Links (a, b) between the distinct values of ``fp`` that keep every group within the radius connected.

    ``agree`` bands must agree for two values to share a shard: more bands make more, smaller shards, and
    never lose a link. Values are assumed distinct and not null.
    """
    keys = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key")) for i, m in enumerate(bands(radius, agree))]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("shard")).select("shard.mask", "shard.key", "fp")
    rows = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return rows.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keep: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Append ``fp`` and ``component_id``, the least id that a document reaches over links of fingerprints.

    Fingerprints link when at most ``radius`` bits differ. Null, empty and wordless texts have fingerprint
    zero and link like any other; equal and repeated rows share a component; a null id belongs to its
    component but is never its name (null if no id is known). Empty tables give no rows. Columns named fp or
    component_id give way to the new ones.
    """
    narrow = stash(add_fingerprint(docs, keep), "fingerprints")
    nodes = stash(narrow.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    n = nodes.count()
    links = link_fingerprints(nodes.select("fp"), radius, agree=1 if n < 50_000_000 else 2 if n < 5_000_000_000 else 3)
    groups = connected_components(links)
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    least = named.where("component is not null").groupBy("component").agg(F.min("least").alias("group_least"))
    of_fp = named.join(least, "component", "left").select("fp", F.coalesce("group_least", "least").alias("component_id"))
    of_fp = stash(of_fp, "fingerprint-groups")
    drop_stash(nodes)
    return narrow.drop("component_id").join(of_fp, "fp").select(*[c for c in narrow.columns if c not in ("fp", "component_id")], "fp", "component_id")


def as_hex(column):
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
