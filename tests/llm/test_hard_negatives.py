import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reckon.llm import hard_negatives as hn
from reckon.llm.vectors import pack

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, width, every=50):
    """Every anchor against every row."""
    live = {}
    for i, v, k in rows:
        if i is None or k is None or v is None or len(v) != width or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        live[i] = min(live[i], (k, w)) if i in live else (k, w)
    out = []
    for a, (k, w) in live.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(w, v)), i, other == k) for i, (other, v) in live.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][: hn.POSITIVES]:
            band = [(-t, i) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][: hn.NEGATIVES]
            out += [(a, p, n, i, -s, t) for n, (t, i) in enumerate(band, 1)]
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect())


def crowd(rng, n, width, labels, spread):
    """Clusters of vectors of many lengths, with copies."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    out = []
    for i in range(n):
        scale = math.exp(rng.uniform(-2, 2))
        out.append((i, [scale * (c + rng.gauss(0, spread)) for c in rng.choice(centres)], rng.randrange(labels)))
        if i % 9 == 8:
            out[-1] = (i, out[-2][1], rng.randrange(labels))
    return out


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_equals_brute_force(spark, spread):
    rng = random.Random(3)
    rows = crowd(rng, 900, 6, 4, spread) + [(5000 + i, [0.5] * 6, 1) for i in range(300)] + [(6000 + 50 * i, [0.5] * 6, i % 3) for i in range(5)]
    rows += [(7000, [0.0] * 6, 1), (7050, [1e9] * 6, 2), (8000, None, 1), (8050, [1.0] * 6, None), (None, [1.0] * 6, 1), (8100, [None] + [1.0] * 5, 1), (8150, [1.0] * 5, 1), (8200, [math.nan] * 6, 1)]
    rows[-7] = (7050, [100.0] * 6, 2)
    rng.shuffle(rows)
    got = run(spark, rows)
    assert got == plain(rows, 6) and len(got) > 150


def test_chunks_of_anchors_make_no_difference(spark, monkeypatch):
    rows = crowd(random.Random(4), 600, 4, 3, 0.3)
    want = run(spark, rows)
    monkeypatch.setattr(hn, "CHUNK_BYTES", 700)
    assert run(spark, rows) == want == plain(rows, 4)


def test_repeated_ids_empty_tables_and_tables_without_anchors(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (50, [0.0, 1.0], 2), (51, [1.0, 0.1], 1), (51, [1.0, 0.1], 1), (52, [0.7, 0.0], 2), (52, [0.7, 0.0], 2)]
    assert run(spark, rows) == [(50, 51, 1, 52, 65536, 256 * 179)]
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == [] and run(spark, [(0, [1.0], 1)]) == []


def test_odd_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 9), (1, [1.0], 1, 9), (2, [0.8], 2, 9)], "vec_id long, embedding array<float>, label int, id int").withColumn("early", F.lit(1)).withColumn("bucket", F.lit("x"))
    assert [tuple(r) for r in hn.mine(df, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 2, 65536, 256 * 204)]


@pytest.mark.parametrize("seed", range(4))
def test_ranges_lose_no_row_and_prune(seed):
    rng = np.random.default_rng(seed)
    n, width = 3000, 16
    sparse = rng.normal(0, 60, (n, width)) * (rng.random((n, width)) < 0.3)
    whole = np.floor(200 * sparse / np.maximum(1, np.linalg.norm(sparse, axis=1))[:, None]).astype(np.int64)
    block = hn.Block(np.arange(n), np.zeros(n, np.int64), whole)
    anchors = hn.Anchors(np.arange(40) + n, np.zeros(40, np.int64), whole[:40], np.zeros((40, 1), np.int64), np.zeros((40, 1), np.int64))
    scores = anchors.whole @ whole.T
    for share in (0.5, 0.8, 0.95, 1.0):
        least = np.ceil(share * anchors.length**2).astype(np.int64)
        kept, some = block.candidates(anchors, np.arange(40), least)
        found = {i: set(range(n)) for i in kept} | {i: set(rows.tolist()) for i, rows in some}
        for i in range(40):
            assert set(np.flatnonzero(scores[i] >= least[i])) <= found.get(i, set())
        if share >= 0.95:
            assert sum(len(x) for x in found.values()) < 0.2 * 40 * n


def test_blocks_keep_buckets_apart_and_rows_whole():
    rng = np.random.default_rng(0)
    buckets = np.sort(rng.integers(0, 3, 20000))[::-1].astype(np.int32)
    whole = rng.integers(-9, 9, (20000, 3))
    batches = [pa.RecordBatch.from_arrays([pa.array(buckets[i : i + 3000]), pa.array(np.arange(20000)[i : i + 3000]), pa.array(np.zeros(20000, np.int64)[i : i + 3000]), pack(whole[i : i + 3000])], names=["bucket", "id", "label", "vector"]) for i in range(0, 20000, 3000)]
    blocks = list(hn._blocks(iter(batches), 3))
    assert all(len(b.ids) <= hn.BLOCK_ROWS and len(set(buckets[b.ids])) == 1 for b in blocks)
    assert np.concatenate([b.ids for b in blocks]).tolist() == list(range(20000)) and (np.concatenate([b.whole for b in blocks]) == whole).all()
