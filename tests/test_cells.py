"""The best spots come from cells of two sides, never from rows of a join: equal to brute force over many cells."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from reckon.operators import views as V
from tests.test_spots import COLUMNS, _value


def test_many_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "ASKED", 7)
    monkeypatch.setattr(V, "HELD", 5)
    monkeypatch.setattr(V, "AT_ONCE", 16)
    rng = random.Random(11)
    rows = [
        ("r", f"{s}{i}", side, dt.date(2000, 1, 1 + rng.randrange(28)), Decimal(rng.choice((1, 900_000_000)) * rng.randrange(100, 9_000)) / 100, rng.choice(("kofi traders", "kofi trader", "zumba")), rng.randrange(5))
        for side, s in (("bank", "B"), ("ledger", "L")) for i in range(60)
    ]
    plans = []
    plain = V._closest
    monkeypatch.setattr(V, "_closest", lambda *a: (plans.append(a), plain(*a))[1])
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r["id"], r["rank"]): (r["o_id"], r["score"]) for r in V.rank_candidates(df, df).collect()}
    want = {}
    for a in rows:
        found = sorted((-_value(a, b, 4), b[6], b[1]) for b in rows if b[2] != a[2] and _value(a, b, 4) > 0.25)
        want |= {(a[1], n): (k, -v) for n, (v, _, k) in enumerate(found[:5], 1)}
    assert plans == [(4, 26, 5)] and got == want


def test_values_are_those_of_decimals():
    """Shares by whole numbers equal Spark's decimals, below and beyond 64 bits."""
    rng = random.Random(5)
    for top in (300, 4 * 10**9, 10**15):
        x = np.array([rng.randrange(1, top) for _ in range(40)])
        y = np.array([max(0, int(v) + rng.choice((-1, 1)) * int(v) // rng.randrange(2, 9999)) for v in x])
        got = V._values(x, y, np.full((40, 40), 3), np.full((40, 40), 0.54), 4)
        for i, j in [(rng.randrange(40), rng.randrange(40)) for _ in range(80)]:
            d, p = Decimal(abs(int(x[i]) - int(y[j]))), Decimal(int(x[i]))
            share = float((d / p).quantize(Decimal("1e-8"), "ROUND_HALF_UP").quantize(Decimal("1e-4"), "ROUND_HALF_UP"))
            assert got[i, j] == int((0.5 * max(0.0, 1 - share * 4) + 0.2 * 0.7 + 0.3 * 0.54) * 100 + 0.5)


def test_rows_without_amount_count_by_date_and_name(spark):
    rows = [("r", "B1", "bank", dt.date(2000, 1, 3), None, "kofi", 1), ("r", "L1", "ledger", dt.date(2000, 1, 3), Decimal("5.00"), "kofi", 2), ("r", "L2", "ledger", None, Decimal("5.00"), "kofi", 3)]
    df = spark.createDataFrame(rows, COLUMNS)
    found = df.limit(1).select("run_id", F.lit("F").alias("finding_id"), "id", F.lit("missing").alias("category"), F.array().cast("array<string>").alias("evidence"))
    pairs = spark.createDataFrame([], "run_id string, pair_id string, pass_name string, score double, status string, bank_ids array<string>, ledger_ids array<string>")
    got = [(r["o_id"], r["similarity"]) for r in V.evidence(found, df, df.limit(0), pairs).where("relation = 'candidate'").collect()]
    assert got == [("L1", 0.5)]
