"""Hard negatives: for anchors and their positives, the best rows of other labels in a band below the positive's score.

Inner products are searched by coordinate pruning. Rows are parted into buckets of similar length; a bucket's blocks
hold for each coordinate the list of its rows sorted by that coordinate. For an anchor, the score that a row must
reach gives a least cosine within a bucket, and that gives each of the anchor's focus coordinates (its largest) a range
of feasible values. Rows in all ranges are candidates and are verified exactly; where the ranges take in most of a
block, the whole block is verified by one product of matrices. Whatever the ranges, no row that could count is
left out.

Anchors are taken in chunks of bounded bytes, each broadcast and met by all rows, block by block. A chunk first meets a
sixteenth of the rows; the k-th best scores found there are what all other rows must reach, so that few of them leave
their task. Longer rows come first in each task, and what it finds raises what the rest of its rows must reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reckon.durable import drop_stash, stash
from reckon.llm.vectors import floors, pack, products, unpack, usable

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Shares of the positive's score between which a negative's score lies, as (numerator, denominator).
LOW, HIGH = (1, 2), (19, 20)
#: Bytes of anchors that are broadcast at once.
CHUNK_BYTES = 8 << 20
#: Rows of a block of a bucket, and anchors that are multiplied with a block at once.
BLOCK_ROWS, STEP = 4096, 512
#: Lengths of a bucket differ by this factor at most.
RATIO = 0.9
FOCUS = 4
#: Ranges that leave a smaller share of a block are intersected; else the block is verified whole.
SELECTIVE = 0.25
EARLY = 16
NONE, ALL = -(1 << 62), 1 << 62
FOUND = "anchor_id long, slot int, id long, score long"


def limit(width: int) -> int:
    """Whole numbers beyond this count as this, so that scores stay below 2^50 (components of over 16384 at 64 of them)."""
    return 1 << ((50 - max(0, width - 1).bit_length()) // 2)


def feasible(theta: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that a coordinate of a unit vector can have at a cosine of at least ``theta`` with a unit vector whose
    coordinate is ``q``: its angle to the axis differs from that of the other by at most the angle between both."""
    between = np.arccos(np.clip(theta, -1.0, 1.0))
    axis = np.arccos(np.clip(q, -1.0, 1.0))
    return np.cos(np.minimum(np.pi, axis + between)) - 1e-9, np.cos(np.maximum(0.0, axis - between)) + 1e-9


class Block:
    """Rows of one length bucket with a sorted list a coordinate, made when first asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, whole
        length = np.sqrt((whole.astype(float) ** 2).sum(axis=1))
        self.longest = float(length.max(initial=0.0))
        self.unit = whole / np.maximum(length, 1.0)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = order, self.unit[order, f]
        return self._lists[f]

    def candidates(self, anchors: Anchors, which: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Of the anchors ``which``, those that need the whole block, and (anchor, positions) of those that do not.

        ``least`` is the score that a row must reach. Anchors that no row of the block can satisfy are in neither.
        """
        cosine = least / np.maximum(anchors.length[which] * self.longest, 1e-300) - 1e-9
        possible = (cosine <= 1.0) | (least <= 0)
        which, cosine = which[possible], np.where(least[possible] > 0, cosine[possible], -1.0)
        focus = anchors.focus[which]
        low, high = feasible(cosine[:, None], np.take_along_axis(anchors.unit[which], focus, axis=1))
        start, end = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(self.ids))
        narrow = high - low < 1.0
        for f in np.unique(focus[narrow]):
            at = np.nonzero(narrow & (focus == f))
            values = self.list_of(int(f))[1]
            start[at], end[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
        if not focus.shape[1]:
            return which, []
        best = (end - start).argmin(axis=1)
        fewest = (end - start).min(axis=1)
        some, whole = [], fewest > SELECTIVE * len(self.ids)
        for i in np.flatnonzero(~whole & (fewest > 0)):
            j = best[i]
            rows = self.list_of(int(focus[i, j]))[0][start[i, j] : end[i, j]]
            inside = self.unit[rows][:, focus[i]]
            rows = rows[((inside >= low[i]) & (inside <= high[i])).all(axis=1)]
            if len(rows):
                some.append((int(which[i]), rows))
        return which[whole], some


class Anchors:
    """A chunk of anchors with the bands their partners' scores must lie in, a band a slot."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.whole, self.low, self.high = ids, labels, whole, low, high
        self.length = np.sqrt((whole.astype(float) ** 2).sum(axis=1))
        self.unit = whole / np.maximum(self.length, 1.0)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]


class Best:
    """The k best rows of each anchor and slot so far: higher scores first, ties by smaller id."""

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.k = anchors, k
        n, slots = anchors.low.shape
        self.score, self.id = np.full((n, slots, k), NONE), np.zeros((n, slots, k), np.int64)
        self.reach = np.where(anchors.low <= anchors.high, anchors.low, ALL)

    def add(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for slot in range(self.reach.shape[1]):
            fit = (score >= self.reach[who, slot]) & (score <= self.anchors.high[who, slot])
            if not fit.any():
                continue
            touched = np.unique(who[fit])
            a = np.concatenate([who[fit], np.repeat(touched, self.k)])
            s = np.concatenate([score[fit], self.score[touched, slot].reshape(-1)])
            x = np.concatenate([ids[fit], self.id[touched, slot].reshape(-1)])
            order = np.lexsort((x, -s, a))
            a, s, x = a[order], s[order], x[order]
            first = np.flatnonzero(np.diff(a, prepend=a[0] - 1))
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
            top = rank < self.k
            self.score[a[top], slot, rank[top]], self.id[a[top], slot, rank[top]] = s[top], x[top]
            self.reach[touched, slot] = np.maximum(self.reach[touched, slot], self.score[touched, slot, -1])

    def meet(self, block: Block, which: np.ndarray, same: bool) -> None:
        """Let the anchors ``which`` meet the rows of a block: those of their own label, or those of others."""
        if not len(which) or not len(block.ids):
            return
        whole, some = block.candidates(self.anchors, which, self.reach[which].min(axis=1))
        pairs = [(np.full(len(rows), i), rows, block.whole[rows] @ self.anchors.whole[i]) for i, rows in some]
        if pairs:
            self._take(block, *(np.concatenate(x) for x in zip(*pairs)), same)
        top = self.anchors.high.max(axis=1)
        for lo in range(0, len(whole), STEP):
            part = whole[lo : lo + STEP]
            scores = products(self.anchors.whole[part], block.whole)
            fits = (scores >= self.reach[part].min(axis=1)[:, None]) & (scores <= top[part][:, None])
            i, rows = np.nonzero(fits)
            self._take(block, part[i], rows, scores[i, rows], same)

    def _take(self, block: Block, who: np.ndarray, rows: np.ndarray, score: np.ndarray, same: bool) -> None:
        fits = (self.anchors.labels[who] == block.labels[rows]) == same
        fits &= self.anchors.ids[who] != block.ids[rows]
        self.add(who[fits], block.ids[rows[fits]], score[fits])

    def table(self) -> pa.RecordBatch:
        who, slot, at = np.nonzero(self.score > NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.ids[who]), pa.array(slot.astype(np.int32)), pa.array(self.id[who, slot, at]), pa.array(self.score[who, slot, at])],
            names=["anchor_id", "slot", "id", "score"],
        )


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    """Blocks of at most ``BLOCK_ROWS`` rows of one bucket, from rows sorted by bucket."""
    held, bucket = [], None

    def made() -> Block:
        ids, labels, whole = (np.concatenate(x) for x in zip(*held))
        held.clear()
        return Block(ids, labels, whole)

    for batch in batches:
        buckets, ids, labels = (batch.column(i).to_numpy() for i in range(3))
        whole = unpack(batch.column(3), width)
        lo = 0
        while lo < len(ids):
            if held and (buckets[lo] != bucket or sum(len(h[0]) for h in held) >= BLOCK_ROWS):
                yield made()
            bucket = buckets[lo]
            ends = np.flatnonzero(buckets[lo:] != bucket)
            hi = min(lo + int(ends[0]) if len(ends) else len(ids), lo + BLOCK_ROWS - sum(len(h[0]) for h in held))
            held.append((ids[lo:hi], labels[lo:hi], whole[lo:hi]))
            lo = hi
    if held:
        yield made()


def _search(rows: DataFrame, width: int, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, id, score): what each task finds for a chunk of anchors among its rows."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(shared.value, k)
        everyone = np.flatnonzero((best.reach < ALL).any(axis=1))
        for block in _blocks(batches, width):
            if not same:
                best.meet(block, everyone, same)
                continue
            order = np.argsort(block.labels, kind="stable")
            values, first = np.unique(block.labels[order], return_index=True)
            by_label = everyone[np.argsort(best.anchors.labels[everyone], kind="stable")]
            labels = best.anchors.labels[by_label]
            for label, lo, hi in zip(values, first, [*first[1:], len(order)]):
                mine = by_label[np.searchsorted(labels, label, "left") : np.searchsorted(labels, label, "right")]
                at = order[lo:hi]
                best.meet(Block(block.ids[at], block.labels[at], block.whole[at]), mine, same)
        yield best.table()

    return rows.select("bucket", "id", "label", "vector").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _top(rows: DataFrame, width: int, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """The k best of all rows for each anchor and slot: first of the early rows, then of the rest that reach those."""
    early = stash(_ranked(_search(rows.where("early"), width, anchors, k, same), k).drop("rank"), "early-found")
    full = early.groupBy("anchor_id", "slot").agg(F.min("score").alias("reach"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).toArrow()
    low = anchors.low.copy()
    order = np.argsort(anchors.ids)
    who = order[np.searchsorted(anchors.ids[order], full.column("anchor_id").to_numpy())] if full.num_rows else np.zeros(0, np.int64)
    slot, reach = full.column("slot").to_numpy(), full.column("reach").to_numpy()
    low[who, slot] = np.maximum(low[who, slot], reach)
    # only raise what is reached; an empty band stays empty
    rest = Anchors(anchors.ids, anchors.labels, anchors.whole, low, anchors.high)
    found = _search(rows.where("not early"), width, rest, k, same)
    return _ranked(early.unionByName(found), k)


def length_buckets(vectors: DataFrame, id_col: str, col: str, label_col: str) -> tuple[DataFrame, int]:
    """(id, label, bucket, vector, early): usable rows in whole numbers, one an id, longer buckets first in each file."""
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{col}`").alias("v"))
    rows, width = usable(named.where("id is not null and label is not null"), "v")
    most = limit(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = floors(batch.column(2), width, SCALE, most)
            length = np.sqrt((whole.astype(float) ** 2).sum(axis=1))
            bucket = np.where(length > 0, np.floor(np.log(np.maximum(length, 1.0)) / -np.log(RATIO)), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bucket), pack(whole)], names=["id", "label", "bucket", "vector"])

    packed = stash(rows.select("id", "label", "v").mapInArrow(run, "id long, label long, bucket int, vector binary"), "packed-vectors")
    again = packed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    again = stash(again, "repeated-ids")
    once = packed
    if not again.isEmpty():
        kept = packed.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector", "bucket")).alias("r"))
        once = packed.join(again, "id", "left_anti").unionByName(kept.select("id", "r.label", "r.bucket", "r.vector"))
    homes = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    early = F.pmod(F.xxhash64("id", F.lit("early")), F.lit(EARLY)) == 0
    dealt = once.withColumn("early", early).repartition(homes, "id").sortWithinPartitions("early", F.desc("bucket"), "id")
    out = stash(dealt, "length-buckets", by=("early",))
    drop_stash(packed)
    return out, width


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ``NEGATIVES`` rows at most for each anchor and positive.

    A row's score is its inner product with the anchor in whole numbers, floor(``SCALE`` * x). An anchor's positives are the
    ``POSITIVES`` best other rows of its label; a positive's negatives are the best rows of other labels with scores
    between ``LOW`` and ``HIGH`` of the positive's. ``is_anchor`` is a condition on ``id_col``. Labels are whole numbers.
    Rows without an id, label or usable vector take no part; of several rows of an id the one of least label, then of
    least vector (by its packed bytes), stands for it, so repeated rows count once. Without anchors there are no rows.
    """
    spark = vectors.sparkSession
    rows, width = length_buckets(vectors, id_col, col, label_col)
    chosen = rows.withColumn(id_col, F.col("id")).where(is_anchor).select("id", "label", "vector")
    chunks = max(1, -(-chosen.count() * (2 * width + 16 + 24 * POSITIVES) // CHUNK_BYTES))
    chosen = stash(chosen.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")), "anchors", by=("chunk",))
    out = None
    for chunk in range(chunks):
        table = chosen.where(F.col("chunk") == chunk).select("id", "label", "vector").orderBy("id").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        vector = table.column("vector").combine_chunks() if table.num_rows else table.column("vector")
        ids, labels, whole = table.column("id").to_numpy(), table.column("label").to_numpy(), unpack(vector.cast(pa.binary()), width)
        wide = np.ones((len(ids), 1), np.int64)
        positives = stash(_top(rows, width, Anchors(ids, labels, whole, wide * (NONE + 1), wide * ALL), POSITIVES, True), "positives")
        got = positives.select("anchor_id", "rank", "score").toArrow()
        low, high = np.full((len(ids), POSITIVES), ALL), np.full((len(ids), POSITIVES), NONE)
        who, slot, score = np.searchsorted(ids, got.column("anchor_id").to_numpy()), got.column("rank").to_numpy() - 1, got.column("score").to_numpy()
        low[who, slot], high[who, slot] = -(-score * LOW[0] // LOW[1]), score * HIGH[0] // HIGH[1]
        negatives = stash(_top(rows, width, Anchors(ids, labels, whole, low, high), NEGATIVES, False), "negatives")
        of = positives.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        made = negatives.join(of, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = made if out is None else out.unionByName(made)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


ORACLE = f"""
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
met AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= {NEGATIVES}
"""
