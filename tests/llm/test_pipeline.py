import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from reckon.llm import language
from reckon.llm.queries import held_out
from tests.llm.test_decontam import brute as brute_contamination
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    """Each stage against a plain Python version over all of the smallest corpus."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "mix_sources", "shard"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language_id"](spark, docs, SF).cache()
    model = language.fit(docs, ~held_out(3, 1))
    said = {r.doc_id: r for r in language.identify(docs, model, keep=["doc_id"]).collect()}
    want = sorted(i for i, r in said.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.ABOVE_CHANCE / len(model.langs))
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == want

    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    groups = brute_components([brute_fingerprint(r.text) for r in rows])
    first = sorted({g: r.doc_id for g, r in reversed(list(zip(groups, rows)))}.values())
    unique = stages["near_dedup"](spark, kept, SF).cache()
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == first

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontaminate"](spark, unique, SF).cache()
    judged = brute_contamination([(r.doc_id, r.text) for r in unique.collect()], items)
    assert clean.columns == columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, x in judged.items() if not x[3])

    mixed = stages["mix_sources"](spark, clean, SF)
    assert mixed.columns == columns
    out = mixed.collect()
    words = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    taken = {}
    for r in out:
        assert len(r.text.split()) <= words[r.doc_id] and r.n_chars == len(r.text)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(taken[i] <= 3 * words[i] for i in taken)
    assert taken == plain_takes([(r.doc_id, r.source, words[r.doc_id]) for r in clean.collect()])

    placed = stages["shard"](spark, spark.createDataFrame(out, mixed.schema), SF).collect()
    assert sorted(r.doc_id for r in placed) == sorted(r.doc_id for r in out)
    assert sorted((r.shard, r.slot) for r in placed) == [(k, i) for k in range(24) for i in range(sum(r.shard == k for r in placed))]
    load = [sum(r.size for r in placed if r.shard == k) for k in range(24)]
    largest = max(r.size for r in placed)
    assert max(load) - min(load) <= largest


def plain_takes(docs):
    """Words taken of each document by the law of the mix: capped targets, and whole rounds and a rest of each line."""
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in docs if t == s) for s in names}
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values())
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[t] for t in open_) > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.discard(s)
        left = sum(size.values()) - sum(target.values())
    total = sum(weight[s] for s in open_)
    target |= {s: left * weight[s] / total for s in open_}
    out = {}
    for s in names:
        take, at = int(target[s] + 1e-9), 0
        for _, i, n in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, t, n in docs if t == s):
            rest = take % size[s] if size[s] else 0
            got = take // max(1, size[s]) * n + max(0, min(n, rest - at))
            at += n
            if got:
                out[i] = got
    return out


def test_mix_is_written_in_the_order_of_the_schedule(spark):
    rows = [(i, f"d{i} " * 64, "en", f"s{i % 3}", 64) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = corpus_pipeline.mix_sources(spark, docs, SF).select("doc_id", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = [r.doc_id % 3 for r in sorted(got, key=lambda r: r.p)]  # stable within a partition
    assert {r.p for r in got} == {0, 1, 2}
    for n in (100, 300, 450, 700):
        for source in range(3):
            assert abs(order[:n].count(source) - n * (source + 1) / 6) < 30


def test_unsure_languages_are_judged_against_chance(spark):
    rows = [(i, ("the and of that with " if i % 2 else "le la les une des ") * 20, "en" if i % 2 else "fr", "a", 100) for i in range(60)]
    rows.append((99, "qzj xkw vvq zzx " * 20, None, "a", 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert set(range(60)) <= kept


def test_odd_documents(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "the and of that " * 20, "en", "a", 320), (4, "the and of that " * 20, None, "b", 320), (5, "le la les une " * 30, "fr", "b", 420), (5, "le la les une " * 30, "fr", "b", 420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            n = now.count()
            assert n == 0 if empty else n > 0, name
