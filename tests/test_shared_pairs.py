"""Pairs that share a bank row and its pair_id stay apart."""

import datetime as dt
from decimal import Decimal

from reckon.operators.reports import reconciled_ledger

TXN = "run_id string, side string, id string, date date, amount decimal(18,2), vendor string, narration string, reference string, account_id string, channel string, ord long, gl_code string"
PAIRS = "run_id string, pair_id string, bank_ids array<string>, ledger_ids array<string>, pass_name string, score double, status string, vendor_part double, ord long"
FINDINGS = "run_id string, finding_id string, covered array<string>, category string, human_category string, risk_score double, status string, ord long"


def test_ledger_lists_each_pair_once(spark):
    row = lambda side, i, gl: ("r", side, i, dt.date(2000, 1, 3), Decimal(50), "kofi", "fee", None, "a", None, 1, gl)
    t = spark.createDataFrame([row("bank", "B", None), row("ledger", "L1", "g1"), row("ledger", "L2", None)], TXN)
    pairs = spark.createDataFrame([("r", "M-B", ["B"], [x], "P", 0.9, "auto", 0.25, 1) for x in ("L1", "L2")], PAIRS)
    out = reconciled_ledger(t, pairs, spark.createDataFrame([], FINDINGS))
    got = sorted((r["bank_ids"], r["ledger_ids"], r["bank_amount"], r["difference"], r["gl_code"]) for r in out.collect())
    assert got == [("B", "L1", "50.00", "0.00", "g1"), ("B", "L2", "50.00", "0.00", "")]
