import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reckon.llm import decontam
from reckon.llm.common import word_hash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        have, hit, met = words(text), set(), set()
        for name, item in items:
            w = words(item)
            size = min(13, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                for j in range(len(have) - size + 1):
                    if have[j : j + size] == w[i : i + size]:
                        hit.update(range(j, j + size))
                        met.add(name)
        out[doc_id] = (len(have), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(have))
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = decontam.find_contamination(d, b, keep=["doc_id"], **kw).collect()
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows}, rows


def corpus(seed, n_docs=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "straße", "THE"]
    items = [(f"i{k}", " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 13, 14, 40])))) for k in range(8)] + [("n", None), ("i3", "w1 w2 w3 w4")]
    docs = []
    for i in range(n_docs):
        parts = [" ".join(rng.choices(vocab + ["zz", "yy"], k=rng.randint(0, 60))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, rng.choice(items)[1] or "")
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(900, None), (901, ""), (902, "--- !"), (903, docs[0][1]), (904, items[6][1] * 40)], items


def test_matches_brute_force(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        assert found(spark, docs, items)[0] == brute(docs, items)


def test_many_blocks_agree(spark):
    docs, items = corpus(3)
    assert found(spark, docs, items, block_bytes=120)[0] == brute(docs, items)


def test_spans_cover_the_hit_words(spark):
    text = "Ünder ä, " + " ".join(f"b{i}" for i in range(13)) + "! tail"
    got, rows = found(spark, [(1, text)], [("a", " ".join(f"B{i}" for i in range(13)))])
    assert got[1][1] == 13
    (span,) = rows[0].spans
    assert text[span.start : span.end] == " ".join(f"b{i}" for i in range(13))


def test_empty_tables(spark):
    assert found(spark, [(1, "a b")], [])[0] == {1: (2, 0, [], False)}
    assert found(spark, [], [("a", "b")])[0] == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=120), st.integers(1, 5))
def test_index_counts_and_locates(symbols, rate):
    text = np.array([*symbols, 0], np.int32)
    index = decontam.FMIndex(text, 3, rate)
    order = decontam.suffix_order(text, 2)

    def key(i):
        out = []
        for j in range(i, len(text)):
            if text[j] == 0:
                return [*out, (0, j)]
            out.append((int(text[j]), 0))

    assert sorted(range(len(text)), key=key) == order.tolist()
    for size in (1, 2, 3, 5):
        for i in range(len(text) - size):
            phrase = text[i : i + size].astype(np.int64)
            if phrase.all():
                lo, hi = index.search(phrase, np.array([0]), np.array([size]))
                want = [j for j in range(len(text) - size + 1) if (text[j : j + size] == phrase).all()]
                assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_hash_is_the_same_anywhere():
    assert word_hash(b"Hello") == word_hash(b"hello") != word_hash(b"hell")
