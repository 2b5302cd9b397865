import numpy as np
from pyspark.sql import functions as F

from reckon.llm import language


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(3)
    model = language.Model.fresh(["a", "b", "c"], 3, rng)
    for name in ("inputs", "recur", "out", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    windows, valid = language.pack([b"hello", b"abcabca", b"z"], 7)
    label = np.array([0, 2, 1])
    _, grads = language.gradients(model, windows, valid, label)
    for name, grad in zip(("inputs", "recur", "out", "bias"), grads):
        param = getattr(model, name)
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in param.shape)
            if name == "inputs":
                at = (at[0], int(windows[0, 1]), at[2])
            old, e = param[at], 1e-2
            param[at] = old + e
            up, _ = language.gradients(model, windows, valid, label)
            param[at] = old - e
            down, _ = language.gradients(model, windows, valid, label)
            param[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-3


def test_learns_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language.fit(docs, ~held, steps=300)
    out = language.identify(docs.where(held & F.col("lang").isNotNull()), model, keep=["doc_id", "lang"])
    rows = out.collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and 0 <= r.position_share <= 1 for r in rows)


def test_odd_texts(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 2.0), (3, "123 !?", "fr", 3.0), (4, "żółw", None, 4.0), (5, "the and " * 30000, "en", 5.0), (5, "the and " * 30000, "en", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train([b"the and of", b"le la et les"], ["en", "fr"], steps=60)
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[4].lang_pred in ("en", "fr")
    assert got[5].lang_pred == "en"
    assert got[1].score == 0 and got[1].lang == "en"
    assert language.identify(df.limit(0), model).count() == 0
    none = language.fit(df, F.lit(False))
    assert none is None
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"}


def test_sample_survives_equal_and_null_ids(spark):
    rows = [(i, f"{lang} text number {i} of this language {lang}", lang) for lang in ("en", "de", "fr", "es") for i in range(300)]
    for ids in (lambda i: 7, lambda i: None, lambda i: i):
        df = spark.createDataFrame([(ids(i), t, lang) for i, t, lang in rows] + [(1, "copied text in es", "es")] * 2000, "doc_id long, text string, lang string")
        got = language.sample(df, F.lit(True), "doc_id", "text", "lang", 50, 96)
        counts = {lang: [r.piece for r in got if r.lang == lang] for lang in ("en", "de", "fr", "es")}
        assert all(len(x) == 50 for x in counts.values())
        assert sum("copied" in p for p in counts["es"]) <= 1


def test_reading_matches_a_plain_network():
    """Windows, padding and pooling against a gated recurrent network written out for one byte at a time."""
    rng = np.random.default_rng(5)
    model = language.Model.fresh(["a", "b", "c"], 4, rng)
    texts = [b"", b"x", bytes(rng.integers(0, 256, 7, dtype=np.uint8)), bytes(rng.integers(0, 256, 31, dtype=np.uint8))]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(side, window):
        h, out = np.zeros(4), []
        for byte in window:
            x, past = model.inputs[side][byte].astype(float), h @ model.recur[side].astype(float)
            z, r = sigmoid(x[:4] + past[:4]), sigmoid(x[4:8] + past[4:8])
            c = np.tanh(x[8:] + r * past[8:])
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    pooled, voted = [], []
    for text in texts:
        p, v = np.zeros(3), np.zeros(3)
        for at in range(0, len(text), 8):
            window = list(text[at : at + 8]) + [0] * (8 - len(text[at : at + 8]))
            ahead, back = states(0, window), states(1, window[::-1])[::-1]
            for t in range(len(text[at : at + 8])):
                e = np.exp(np.concatenate([ahead[t], back[t]]) @ model.out.astype(float) + model.bias)
                p += e / e.sum()
                v[(e / e.sum()).argmax()] += 1
        pooled.append(p / max(1, len(text)))
        voted.append(v / max(1, len(text)))
    got_p, got_v = language.predict(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), window=8)
    assert np.allclose(got_p, pooled, atol=1e-5) and np.allclose(got_v, voted, atol=1e-6)
