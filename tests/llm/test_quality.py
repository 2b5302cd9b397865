import numpy as np
from pyspark.sql import functions as F

from reckon.llm import quality


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    d = (1 << quality.WORD_BITS) + len(quality.STATS)
    machine = quality.Machine(0.3, rng.normal(size=d) * 0.1, rng.normal(size=(d, 3)) * 0.2, np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    texts = [b"one two two THREE!", b"", b"x *** | 9 y.\nz"]
    offsets = np.cumsum([0, *map(len, texts)])
    stats, text, bucket, share = quality.statistics(np.frombuffer(b"".join(texts), np.uint8), offsets)
    got = machine.score(stats, text, bucket, share)
    form = quality.standard(stats, machine.centre, machine.scale)
    for i in range(3):
        x = np.zeros(d)
        x[bucket[text == i]] = share[text == i]
        x[-len(quality.STATS) :] = form[i]
        y = machine.bias + machine.weights @ x
        used = np.flatnonzero(x)
        for a in used:
            for b in used:
                if a < b:
                    y += machine.factors[a] @ machine.factors[b] * x[a] * x[b]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(y, -30, 30)))) < 1e-9


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_ranking(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    machine = quality.fit(docs, labels, ~held, sample_rows=2500)
    got = quality.add_score(docs.where(held), machine, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.97


def test_odd_rows(spark):
    rows = [(1, None, 0.1), (2, "", 0.2), (3, " \n", 0.3), (4, "word " * 60000, 0.4), (4, "word " * 60000, 0.4), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 1), (None, 1), (2, None)], "doc_id long, quality int")
    machine = quality.fit(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.add_score(docs, machine).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert quality.add_score(docs.limit(0), machine).count() == 0
    assert quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality.add_score(docs, None).collect()} == {0.5}


def test_one_id_in_many_rows_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "a"), (2, None), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, F.lit(True)).collect()
    assert sorted((r.id, r.label) for r in rows) == [(1, 1), (2, 0), (3, 1)]
