"""Ranked counterparts and evidence of rows that are alike: equal to brute force, by spots and not by pairs of rows."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from reckon.functions.similarity import vendor_similarity
from reckon.operators import views as V

COLUMNS = "run_id string, id string, side string, date date, amount decimal(18,2), vendor string, ord long"


def _rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    spots = [(dt.date(2000, 1, 1 + rng.randrange(28)), Decimal(rng.choice((-1, 1)) * rng.randrange(1, 30_000)) / 100, rng.choice(("kofi traders", "kofi trader", "zumba"))) for _ in range(8)]
    return [("r", f"{s}{i}", side, *rng.choice(spots), rng.randrange(9)) for side, s in (("bank", "B"), ("ledger", "L")) for i in range(n)]


def _half_up(x: float) -> float:
    return int(x * 100 + 0.5) / 100


def _value(a: tuple, b: tuple, steep: int) -> float:
    share = float(round(Decimal(abs(abs(a[4]) - abs(b[4])) / abs(a[4])), 4))
    return _half_up(0.5 * max(0.0, 1 - share * steep) + 0.2 * max(0.0, (10 - abs((a[3] - b[3]).days)) / 10) + 0.3 * float(vendor_similarity([a[5]], [b[5]])[0]))


def test_candidates_equal_brute_force(spark):
    rows = _rows(40, 3)
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r["id"], r["rank"]): (r["o_id"], r["score"]) for r in V.rank_candidates(df, df).collect()}
    want = {}
    for a in rows:
        found = sorted((-_value(a, b, 4), b[6], b[1]) for b in rows if b[2] != a[2] and (a[4] < 0) == (b[4] < 0) and _value(a, b, 4) > 0.25)
        want |= {(a[1], n): (k, -v) for n, (v, _, k) in enumerate(found[:5], 1)}
    assert got == want


def test_evidence_equals_brute_force(spark):
    rows = _rows(40, 5)
    df = spark.createDataFrame(rows, COLUMNS)
    cites = {"B1": ["L2", "B3"], "L4": ["L5"]}
    of = F.create_map(*[x for k, v in cites.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = df.select("run_id", F.concat(F.lit("F-"), "id").alias("finding_id"), "id", F.lit("missing").alias("category"), F.try_element_at(of, F.col("id")).alias("evidence"))
    pairs = spark.createDataFrame([], "run_id string, pair_id string, pass_name string, score double, status string, bank_ids array<string>, ledger_ids array<string>")
    got = {(r["finding_id"], r["relation"], r["rank"]): r["o_id"] for r in V.evidence(found, df, df.limit(0), pairs).collect() if r["o_id"] not in cites.get(r["finding_id"][2:], [])}
    want = {}
    for a in rows:
        free = [b for b in rows if b[1] != a[1] and b[1] not in cites.get(a[1], [])]
        best = sorted((-_value(a, b, 1), b[6], b[1]) for b in free if b[2] != a[2] and _value(a, b, 1) >= 0.5)[:3]
        own = sorted((b[6], b[1]) for b in free if b[2] == a[2] and b[5] == a[5])[:3]
        want |= {(f"F-{a[1]}", "candidate", n): k for n, (*_, k) in enumerate(best, 1)} | {(f"F-{a[1]}", "vendor_history", n): k for n, (_, k) in enumerate(own, 1)}
    assert got == want


def test_pairs_of_copies_are_not_formed(spark, monkeypatch):
    """Of 600 copies on each side a pair of spots is judged once."""
    seen = []
    plain = V._similarity
    monkeypatch.setattr(V, "_similarity", lambda df, *names: (seen.append(df.count()), plain(df, *names))[1])
    day = dt.date(2000, 1, 3)
    df = spark.createDataFrame([("r", f"{s}{i:03}", side, day, Decimal("5.00"), "kofi", i) for side, s in (("bank", "B"), ("ledger", "L")) for i in range(600)], COLUMNS)
    found = df.select("run_id", F.concat(F.lit("F-"), "id").alias("finding_id"), "id", F.lit("missing").alias("category"), F.array().cast("array<string>").alias("evidence"))
    pairs = spark.createDataFrame([], "run_id string, pair_id string, pass_name string, score double, status string, bank_ids array<string>, ledger_ids array<string>")
    assert V.evidence(found, df, df.limit(0), pairs).count() == 1200 * 6
    assert sum(seen) < 3700
