import datetime as dt
import random
import statistics
from decimal import Decimal

from pyspark.sql import functions as F

from reckon.operators import detectors as D
from reckon.operators import findings as G
from reckon.operators import matching as M
from reckon.operators import medians, mining
from reckon.plans.config import DETECTORS, P1, P2, P4, Classify, Hold, Rules, Tolerance, Withheld, compile_rules


def test_medians_of_earlier_periods_match_brute_force(spark):
    rng = random.Random(8)
    periods = [f"2026-{m:02}" for m in range(1, 13)]
    rows = [("bank" if rng.random() < 0.5 else "ledger", rng.choice("abc"), rng.choice(periods), Decimal(rng.choice([rng.randint(-500, 500), rng.randint(-(10**7), 10**7), 4200])) / 100) for _ in range(1500)]
    rows += [("bank", "flat", "2026-01", Decimal("7.00"))] * 400 + [("bank", "zero", "2026-02", Decimal("0.00"))] * 6 + [("bank", "few", "2026-01", Decimal(1))] * 4
    past = spark.createDataFrame(rows, "side string, vendor string, period string, amount decimal(18,2)")
    keys = [(s, v, p) for s in ("bank", "ledger") for v in ("a", "b", "c", "flat", "zero", "few", "none") for p in periods]
    asked = spark.createDataFrame(keys, "side string, vendor string, period string")
    got = {(r.side, r.vendor, r.period): (r.n, r.median, r.mad) for r in medians.medians_before(past, asked).collect()}
    want = {}
    for s, v, p in keys:
        x = [abs(a) for s2, v2, p2, a in rows if (s2, v2) == (s, v) and p2 < p]
        if len(x) >= 5:
            m = statistics.median(x)
            want[s, v, p] = (len(x), m, statistics.median(abs(a - m) for a in x))
    assert got == want
    assert medians.medians_before(past, asked.limit(0)).count() == 0


def test_history_of_vendors(spark):
    rng = random.Random(3)
    periods = ["2026-01", "2026-02", "2026-03", "2026-04"]
    rows = [(rng.choice(["bank", "ledger"]), rng.choice("abcd"), dt.date(2026, 1 + periods.index(p), rng.randint(1, 28)), Decimal(1), p) for p in periods for _ in range(6)]
    past = spark.createDataFrame(rows, "side string, vendor string, date date, amount decimal(18,2), period string")
    runs = spark.createDataFrame([(f"r{i}", p) for i, p in enumerate(periods + ["2026-03"])], "run_id string, period string")
    got = {(r.run_id, r.side, r.vendor): (r.n, r.first_seen) for r in D.run_history(past, runs).collect()}
    want = {}
    for run, p in ((f"r{i}", p) for i, p in enumerate(periods + ["2026-03"])):
        for s, v, day, _, q in rows:
            if q < p:
                n, first = want.get((run, s, v), (0, day))
                want[run, s, v] = (n + 1, min(first, day))
    assert got == want


def test_random_widths_lose_nothing(spark):
    rng = random.Random(12)
    for width in ("0.1", "0.07", "1.1", "0.3", "13.37", "2"):
        w = Decimal(width)
        left = [(i, w * rng.randint(-30, 30) + Decimal(rng.randint(-2, 2)) / 100) for i in range(120)]
        right = [(i, w * rng.randint(-30, 30) + Decimal(rng.randint(-2, 2)) / 100) for i in range(120)]
        a = spark.createDataFrame([(1, i, x) for i, x in left], "k int, a int, x decimal(18,2)")
        b = spark.createDataFrame([(1, i, x) for i, x in right], "k int, b int, y decimal(18,2)")
        got = sorted(map(tuple, M.near_join(a, b, ["k"], [(F.col("x"), F.col("y"), w)]).select("a", "b").collect()))
        assert got == sorted((i, j) for i, x in left for j, y in right if abs(x - y) <= w), width


def test_five_thousand_equal_fees(spark):
    schema = "run_id string, side string, id string, date date, amount decimal(18,2), vendor string, narration string, reference string, account_id string, channel string, ord long"
    day = dt.date(2026, 9, 1)
    rows = [("r", s, f"{s[0]}{i:05}", day, Decimal("-11.80"), "bank fee", "fee", None, "a", None, i) for s in ("bank", "ledger") for i in range(5000 if s == "bank" else 4990)]
    pairs = M.one_to_one(spark.createDataFrame(rows, schema), M.Pass(P1, "exact", 0, Decimal(0), 0.9))
    got = pairs.select(F.get("bank_ids", F.lit(0)).alias("b"), F.get("ledger_ids", F.lit(0)).alias("l")).collect()
    assert len(got) == len({r.b for r in got}) == len({r.l for r in got}) == 4990


def test_default_settings():
    weights = {d: (x.threshold, x.weight) for d, x in DETECTORS.items()}
    assert weights["period_boundary"] == (5, 0.5) and weights["round_amount"] == (0.5, 0.3) and weights["no_counterpart"] == (0.5, 0.5) and weights["duplicate_detector"] == (0.8, 1)


def test_stored_rules():
    stored = [
        {"id": "R1", "params": {"pass": 1, "dateToleranceDays": 1}}, {"id": "R2", "params": {"pass": 9, "dateToleranceDays": 1}}, {"id": "R3", "params": {"maxGroupSize": 7, "dateToleranceDays": 4}},
        {"id": "R4", "scope": "vendor", "scope_value": "Kofi", "params": {"aliases": ["KF", "KOFI X"]}}, {"id": "R5", "params": {"pattern": "^chrg", "maxAmount": "2,000.00"}}, {"id": "R6", "params": {"pattern": "("}},
        {"id": "R7", "params": {"action": "route_to_review", "weekdays": ["Sat", "sunday", "?"], "channel": "RTGS"}}, {"id": "R8", "params": {"tdsRate": 0.02}}, {"id": "R9", "enabled": False, "params": {"tdsRate": 0.1}},
        {"id": "R10", "scope": "account", "scope_value": "HDFC 4417", "params": {"amountTolerance": "0.01"}}, {"id": "R11", "scope": "global", "params": {"vendor": "Zumba", "dateToleranceDays": 5, "vendorThreshold": 0.7}}, {"id": "R12", "scope": "global", "params": {"dateToleranceDays": 5}}, {"id": "R13", "params": None},
    ]
    config = {"passes": [{"name": "P1 · Exact"}, {"name": "P2 · Date", "dateToleranceDays": 3, "amountTolerance": "1.00"}, {"name": "P4 · Group"}]}
    got = compile_rules(stored, config, [{"id": "acc0", "last4": "4417", "name": "Current", "bank": "HDFC"}])
    assert [(p.name, p.days, p.max_group) for p in got.passes] == [(P1, 1, 7), (P2, 3, 7), (P4, 4, 7)]
    assert config["passes"][0] == {"name": "P1 · Exact"}
    assert got.aliases == (("R4", "Kofi", ("KF", "KOFI X")),) and got.pass_rules == {P1: "R1", P4: "R3"}
    assert got.rules == Rules(
        (Tolerance("R10", "account", "HDFC 4417", amount=Decimal("0.01")), Tolerance("R11", "vendor", "Zumba", 5, None, 0.7)), (Hold("R7", (5, 6), "RTGS"),), (Withheld("R8", Decimal("0.02")),),
        (Classify("R5", "^chrg", "missing", Decimal("2000.00")),), {"acc0": ("acc0", "4417", "Current", "HDFC")},
    )
    assert compile_rules([], {}).passes[0].kind == "exact"


def test_findings_cover_each_row_once_in_order(spark):
    """Against the rule row by row: a row that an earlier finding covers makes none; its first free partner is taken."""
    rng = random.Random(2)
    rows, edges = [], []
    for i in range(120):
        rows.append((f"r{i % 3}", f"t{i:03}", rng.choice(["bank", "ledger"]), dt.date(2026, 9, rng.randint(1, 28))))
    for run, i, _, _ in rows:
        mates = [x[1] for x in rows if x[0] == run and x[1] != i]
        if rng.random() < 0.6:
            edges.append((run, i, "amount_mismatch", 7, [rng.choice(mates)], {}))
        if rng.random() < 0.2:
            other = rng.choice(mates)
            edges.append((run, i, "no_counterpart", 9, [other], {"otherAccountTxn": other}))
    signals = spark.createDataFrame(edges, "run_id string, id string, detector string, place int, evidence array<string>, details map<string,string>")
    open_ = spark.createDataFrame(rows, "run_id string, id string, side string, date date")
    got = {(r.run_id, r.id): list(r.covered) for r in G.cover(open_, signals).collect()}
    # the same with wide components thinned out in rounds
    assert {(r.run_id, r.id): list(r.covered) for r in G.cover(open_, signals, wide_rows=12).collect()} == got
    want = {}
    for run in ("r0", "r1", "r2"):
        crossed = {i for r, i, d, *_ in edges if r == run and d == "no_counterpart"}
        mine = [(not (i in crossed and s == "ledger"), s != "bank", day, i) for r, i, s, day in rows if r == run]
        done = set()
        for *_, i in sorted(mine):
            if i in done:
                continue
            partners = [e[0] for r, j, _, place, e, _ in sorted(edges, key=lambda x: x[3]) if (r, j) == (run, i)]
            free = [p for p in partners if p not in done and p != i][:1]
            want[run, i] = [i, *free]
            done.update(want[run, i])
    assert got == want


def test_rows_of_a_hot_partner_settle_in_two_rounds(spark):
    rows = [("r", "hub", "ledger", dt.date(2026, 9, 1))] + [("r", f"t{i:04}", "bank", dt.date(2026, 9, 2)) for i in range(3000)]
    open_ = spark.createDataFrame(rows, "run_id string, id string, side string, date date")
    signals = open_.where("side = 'bank'").selectExpr("run_id", "id", "'amount_mismatch' AS detector", "7 AS place", "array('hub') AS evidence", "map('side', 'bank') AS details")
    edges = G.partner_edges(signals)
    turn = F.struct(F.lit(True).alias("late"), (F.col("side") != "bank").alias("not_bank"), "date", "id")
    tied = open_.select(F.lit("c").alias("component"), "run_id", "id", turn.alias("turn"))
    left, made = G.thin_out(tied, edges, 100)
    assert left.count() == 0 and [m.count() for m in made] == [1, 2999]
    assert made[0].collect()[0].covered == ["t0000", "hub"]


def test_date_proposals_replay_touched_rows_only(spark, monkeypatch):
    """The same gains as on whole copies of the runs, from fewer rows."""
    rng = random.Random(21)
    rows = []
    for i in range(400):
        vendor, amount = rng.choice(["kofi traders", "zumba fitness", "blast media", "orion labs"]), rng.randint(1, 25) * 100
        day = dt.date(2026, 9, rng.randint(1, 18))
        rows.append((f"r{i % 2}", "ledger", f"l{i:03}", day, Decimal(-amount), vendor, "", None, "a", None, i))
        if rng.random() < 0.7:
            late = rng.choice([0, 1, 2, 5, 8]) if vendor.startswith(("kofi", "zumba")) else rng.choice([0, 1, 2])
            rows.append((f"r{i % 2}", "bank", f"b{i:03}", day + dt.timedelta(days=late), Decimal(-amount) + Decimal(rng.choice(["0.00", "0.00", "0.50"])), vendor, "", None, "a", None, i))
    t = spark.createDataFrame(rows, "run_id string, side string, id string, date date, amount decimal(18,2), vendor string, narration string, reference string, account_id string, channel string, ord long").cache()
    told = lambda: sorted(map(tuple, mining.date_proposals(t).collect()))
    sizes = []
    real = mining.touched_rows

    def counted(*a):
        out = real(*a)
        sizes.append((out.count(), out.select("trial").distinct().count()))
        return out

    monkeypatch.setattr(mining, "touched_rows", counted)
    got = told()
    monkeypatch.setattr(mining, "touched_rows", lambda unmatched, found, flags=None: unmatched.join(found.select("run_id", "trial"), "run_id").select("run_id", "side", "id", "trial"))
    assert got == told() and len(got) >= 2
    n, trials = sizes[0]
    assert n < 0.8 * t.count() / 2 * trials
