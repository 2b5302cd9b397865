import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from reckon.llm import vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, width, parts=4, entries=256, rounds=4):
    """Lloyd's method in whole numbers, row by row."""
    keep = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    by_id = {}
    for i, v, _ in keep:
        if i is not None:
            by_id[i] = min(v, by_id.get(i, v))
    start = [by_id[i] for i in sorted(by_id)[:entries]]
    step = width // parts
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    books = [[cut(v)[p] for v in start] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in keep:
            for p, x in enumerate(cut(v)):
                members[p, near(p, x)[1]].append(x)
        for (p, k), xs in members.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], defaultdict(int)
    for i, v, k in keep:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, k, "".join(f"{e:02x}" for _, e in found), sum(g for g, _ in found)))
        by_label[k] += out[-1][3]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, k, c, g, by_label[k], sha) for i, k, c, g in out), key=str)


def run(spark, rows):
    return sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_equals_plain_lloyd_with_copies_nulls_and_ties(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 0.3) for _ in range(8)]
    hot = vec()
    rows = [(i, vec(), rng.choice([None, 0, 1, 2])) for i in range(500)]
    rows += [(1000 + i, hot, 1) for i in range(250)] + [(2000 + i, [round(x, 1) for x in vec()], 3) for i in range(100)]
    rows += [(7, rows[7][1], rows[7][2]), (7, vec(), 0), (None, vec(), 2), (None, vec(), None)]
    rows += [(3000, None, 1), (3001, [None] + vec()[1:], 1), (3002, [float("nan")] + vec()[1:], 1), (3003, [float("-inf")] + vec()[1:], 1), (3004, vec()[:7], 1), (3005, [], 1)]
    rng.shuffle(rows)
    got = run(spark, rows)
    assert got == plain(rows, 8) and len(got) == 854
    assert got == run(spark, rows[::-1])


def test_few_rows_and_none(spark):
    few = [(5, [0.5, 1.5, -0.25, 1e9], None), (4, [0.5, 1.5, -0.25, 0.0], 1)]
    got = run(spark, few)
    assert [(r[0], r[2], r[3]) for r in got] == [(4, "00000000", 0), (5, "00000001", 0)]
    assert run(spark, []) == [] and run(spark, [(1, None, 1), (2, [], None)]) == [] and run(spark, [(None, [1.0, 2.0], 1)]) == []
    assert [r[2] for r in run(spark, [(1, [1.0, 2.0], 1)])] == ["00000000"]  # two parts are empty


def test_only_members_that_change_their_entry_migrate(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(0, 0.2, (1500, 8)))]
    sizes = defaultdict(list)
    real = vector_codes.stash

    def counted(df, name, by=()):
        out = real(df, name, by)
        sizes[name].append(out.count())
        return out

    monkeypatch.setattr(vector_codes, "stash", counted)
    run(spark, rows)
    assert sizes["judged-members"] == sizes["members"] * 3 and 5900 < sizes["members"][0] <= 6000
    assert 0 < sizes["arrived-members"][-1] < sizes["arrived-members"][0] < 3000


@pytest.mark.parametrize("most", [100, 1 << 14, 1 << 20, 1 << 27])
def test_distances_and_bytes_are_exact(most):
    rng = np.random.default_rng(most)
    rows, book = rng.integers(-most, most + 1, (200, 16)), rng.integers(-most, most + 1, (50, 16))
    book[20] = book[10]
    at, gap = vector_codes.nearest(rows, book)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(book)) for r in rows]
    assert [(int(g), int(k)) for g, k in zip(gap, at)] == want
    rows[::3] //= max(1, most // 50)
    packed = vectors.pack(rows)
    assert (vectors.unpack(packed, 16) == rows).all() and (vectors.unpack(packed.slice(3, 20), 16) == rows[3:23]).all()
