"""The search of the other side against brute force, and the pairs that it forms."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from reckon.functions.similarity import vendor_similarity
from reckon.operators import lookups as L

COLUMNS = "run_id string, id string, side string, date date, amount decimal(18,2), vendor string, ord long"


def _rows(n: int, seed: int, high: int, names: tuple[str, ...]) -> list[tuple]:
    rng = random.Random(seed)
    at = lambda: dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(28))
    amount = lambda: None if rng.random() < 0.03 else Decimal(rng.choice((-1, 1, 1)) * rng.randrange(0, high)) / 100
    return [("r", f"{s}{i}", side, at(), amount(), rng.choice(names), rng.randrange(9)) for side, s in (("bank", "B"), ("ledger", "L")) for i in range(n)]


@pytest.mark.parametrize("high", [60, 9_000, 3_000_000])
def test_search_equals_brute_force(spark, high):
    rows = _rows(60, high, high, ("kofi traders", "kofi trader", "zumba", "hexly"))
    df = spark.createDataFrame(rows, COLUMNS)
    got = {(r["id"], r["rank"]): r["o_id"] for r in L.search_other_side(df, df).collect()}
    want = {}
    for _, i, side, day, amount, name, _ in rows:
        found = []
        for _, k, other, on, much, called, place in rows:
            if other == side or abs((on - day).days) > 7:
                continue
            alike = float(vendor_similarity([name], [called])[0])
            gap = None if amount is None or much is None else abs(much - amount)
            if (gap is not None and gap <= abs(amount) * Decimal("0.25")) or alike >= (0.6 if amount is None else 0.8):
                found.append((gap or Decimal(0), -alike, place, k))
        want |= {(i, n): k for n, (*_, k) in enumerate(sorted(found)[:8], 1)}
    assert got == want


def test_search_forms_few_pairs(spark, monkeypatch):
    """Of 2 x 1200 rows of one run some 1.4 million pairs lie within days; names are compared of a few for each row only."""
    seen = []
    plain = L.with_similarity
    monkeypatch.setattr(L, "with_similarity", lambda df, *names: (seen.append(df.count()), plain(df, *names))[1])
    df = spark.createDataFrame([r for r in _rows(1200, 7, 30_000_000, ("kofi", "zumba", "hexly")) if r[4] is not None], COLUMNS)
    assert L.search_other_side(df, df).count() > 15_000
    assert sum(seen) < 60_000
