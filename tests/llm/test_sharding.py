import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from reckon.llm import sharding


def check(docs, got, shards=24):
    assert len(got) == len(docs)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    load = np.zeros(shards)
    for r in got:
        load[r.shard] += r["size"]
    return load


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, size string")
    return sharding.shard(df).collect()


def test_loads_are_near_equal_and_groups_stay_together(spark):
    rng = random.Random(3)
    docs = [(i, f"{i % 3000} " + "word " * int(rng.lognormvariate(5, 1))) for i in range(6000)]
    docs += [(10_000 + i, "the same text in many rows") for i in range(3000)]
    docs += [(20_000, None), (20_001, ""), (None, "no id"), (5, docs[5][1]), (5, docs[5][1])]
    rng.shuffle(docs)
    got = run(spark, docs)
    load = check(docs, got)
    assert load.max() < 1.01 * load.mean() and load.min() > 0.99 * load.mean()
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    hot = zlib.crc32(b"the same text in many rows")
    assert all(len(s) == 1 for c, s in homes.items() if c != hot)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, run(spark, docs)), key=str)


def test_pack_follows_the_dot_product():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(5, 1, (400, 3))
    room = np.tile(sizes.sum(axis=0) / 5, (5, 1))
    where = sharding.pack(sizes, room)
    unit, left = room.sum(axis=0), room.copy()
    for i in sorted(range(400), key=lambda i: -sizes[i, 0] / unit[0]):
        dots = [(sharding.EMPHASIS * sizes[i] / unit * left[s] / unit).sum() for s in range(5)]
        assert dots[where[i]] >= max(dots) - 1e-12
        left[where[i]] -= sizes[i]


def test_few_and_no_rows(spark):
    assert run(spark, []) == []
    check([(1, "a")], run(spark, [(1, "a")]))
    check([(1, None), (2, None)], run(spark, [(1, None), (2, None)]))
