import random

import numpy as np
import xxhash

from reckon.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=4):
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_match_brute_force(spark):
    texts = [None, "", " \n\t", "One", "a b", "a b c d", "A b\x0bc\x0cd e", "é ü x y z w É", "x " * 500, " ".join(map(str, range(3000)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.add_fingerprint(df, ["doc_id"]).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_jvm_hash_is_the_same(spark):
    row = spark.sql("select lower(lpad(hex(xxhash64('a b c d')), 16, '0')) h").first()
    assert row.h == f"{xxhash.xxh64_intdigest(b'a b c d', 42):016x}"


def chain(rng, n):
    """Random values with planted neighbours, chains and one dense ball."""
    values = [rng.getrandbits(64) for _ in range(n)]
    for v in values[: n // 4]:
        for _ in range(3):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            values.append(v)
    centre = rng.getrandbits(64)
    values += [centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(200)]
    return sorted(set(values) | {0, 2**64 - 1, 2**63})


def test_links_connect_the_same_groups(spark):
    values = chain(random.Random(5), 300)
    want = brute_components(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for agree in (1, 2, 3):
        pairs = simhash.link_fingerprints(df, 4, agree).collect()
        label = {v: v for v in signed}

        def find(i):
            while label[i] != i:
                i = label[i]
            return i

        for a, b in pairs:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 64
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
        got = [find(v) for v in signed]
        assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_components_of_documents(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    docs = []
    for i, t in enumerate(base):
        docs += [(i * 10 + 5, t), (i * 10 + 3, t)]
        w = t.split()
        for k in range(3):
            w[rng.randrange(300)] = "changed"
            docs.append((i * 10 + 6 + k, " ".join(w)))
    docs += [(500, None), (501, ""), (501, ""), (None, base[0])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df, keep=["doc_id"]).collect()
    assert len(got) == len(docs)
    values = [brute_fingerprint(t) for _, t in docs]
    group = brute_components(values)
    least = {}
    for (i, _), g in zip(docs, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((-1 if i is None else i, v, least[g]) for (i, _), v, g in zip(docs, values, group))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
