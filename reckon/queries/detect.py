"""Queries of detectors and findings."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from reckon.operators import detectors as D
from reckon.operators import findings as G
from reckon.plans.config import Classify, Rules, compile_rules
from reckon.queries.state import SQL, State, flat
from reckon.sources import fixture

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, whole: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if whole else f"{SQL} {sql}"
        return f

    return add


_HIST = "h AS (SELECT r.run_id, x.side, x.vendor, x.date, x.amount FROM i x JOIN runs q ON q.run_id = x.run_id JOIN runs r ON q.period < r.period)"


@query(f", {_HIST} SELECT run_id, side, vendor, count(*) AS n, min(date) AS first_seen FROM h GROUP BY run_id, side, vendor")
def dt0_history(spark, d):
    runs = fixture.runs(spark, d)
    return D.run_history(D.finished_rows(fixture.txns(spark, d), runs), runs)


def _inr(x: str) -> str:
    """An absolute amount in Indian grouping as SQL text."""
    p = f"CAST(floor(abs({x})) AS BIGINT)"
    groups = f"ltrim(reverse(regexp_replace(reverse(CAST({p} // 1000 AS VARCHAR)), '([0-9][0-9])', '\\1,', 'g')), ',')"
    whole = f"CASE WHEN {p} < 1000 THEN CAST({p} AS VARCHAR) ELSE {groups} || ',' || lpad(CAST({p} % 1000 AS VARCHAR), 3, '0') END"
    return f"('₹' || {whole} || '.' || lpad(CAST(CAST(abs({x}) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0'))"


def _money(x: str) -> str:
    return f"CAST(CAST(abs({x}) AS DECIMAL(18,2)) AS VARCHAR)"


#: Each detector's signals as SQL over unmatched rows ``u``, all rows ``i``, history ``h`` and out-of-period rows ``x``:
#: run_id, id, raw, evidence, details (key=value by key, joined by ;) and text.
_DT = {
    "duplicate_detector": f"""SELECT run_id, id, CAST(0.6 AS DOUBLE) AS raw, o_id AS evidence, 'amountEqual=true;daysApart=' || CAST(abs(days) AS VARCHAR) || ';matchedTxn=' || o_id AS details,
 'Same amount ' || {_inr("amount")} || ' and ' || CASE side WHEN 'bank' THEN 'payee' ELSE 'vendor' END || ' as ' || o_id || ' ' || CASE WHEN days = 0 THEN 'on the same day' ELSE CAST(abs(days) AS VARCHAR) || ' day' || CASE WHEN abs(days) = 1 THEN '' ELSE 's' END || CASE WHEN days > 0 THEN ' earlier' ELSE ' later' END END AS text
 FROM (SELECT t.*, o.id AS o_id, t.date - o.date AS days, row_number() OVER (PARTITION BY t.run_id, t.id ORDER BY o.ord, o.id) AS n FROM u t JOIN i o ON o.run_id = t.run_id AND o.side = t.side AND o.amount = t.amount
  AND o.vendor = t.vendor AND abs(o.date - t.date) <= 3 AND o.id <> t.id LEFT JOIN u v ON v.run_id = o.run_id AND v.id = o.id WHERE v.id IS NULL OR (o.date, o.id) <= (t.date, t.id)) WHERE n = 1""",
    "approval_limit": f"""SELECT run_id, id, CASE WHEN below <= 0.01 THEN CAST(0.78 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS raw, '' AS evidence,
 'amount=' || {_money("amount")} || ';limit=100000.00;pctBelow=' || CAST(floor(below * 100 * 100 + 0.5) / 100 AS VARCHAR) AS details, 'Amount ' || {_inr("amount")} || ' is ' || printf('%.1f', below * 100) || '% below the ₹1,00,000.00 approval limit' AS text
 FROM (SELECT *, CAST((100000 + amount) / 100000 AS DOUBLE) AS below FROM u WHERE amount < 0 AND -amount < 100000) WHERE below <= 0.02""",
    "new_vendor": """SELECT run_id, id, CASE WHEN known THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS raw, '' AS evidence,
 CASE WHEN known THEN 'firstSeen=' || strftime(first_seen, '%Y-%m-%d') || ';' ELSE 'inVendorMaster=false;' END || 'priorPayments=0' AS details,
 CASE WHEN known THEN 'Vendor first seen ' || CAST(age AS VARCHAR) || ' day' || CASE WHEN age = 1 THEN '' ELSE 's' END || ' before this payment (' || strftime(first_seen, '%d %b') || '); no prior payments' ELSE 'Counterparty not in the vendor/customer master; first payment to this beneficiary' END AS text
 FROM (SELECT t.run_id, t.id, coalesce(k.known, false) AS known, k.first_seen, t.date - k.first_seen AS age FROM u t
  LEFT JOIN (SELECT run_id, vendor, min(date) AS first_seen, bool_or(side = 'ledger') AS known FROM (SELECT run_id, vendor, date, side FROM h UNION ALL SELECT run_id, vendor, date, side FROM i WHERE side = 'ledger') GROUP BY run_id, vendor) k
   ON k.run_id = t.run_id AND k.vendor = t.vendor WHERE t.side = 'bank' AND abs(t.amount) >= 5000 AND NOT EXISTS (SELECT 1 FROM h WHERE h.run_id = t.run_id AND h.vendor = t.vendor AND h.side = 'bank')) WHERE NOT known OR age BETWEEN 0 AND 30""",
    "weekend_payment": """SELECT run_id, id, CASE WHEN ends = 0 THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.45 AS DOUBLE) END AS raw, '' AS evidence, 'channel=' || channel || ';priorWeekend=' || CAST(ends AS VARCHAR) || ';weekday=' || strftime(date, '%A') AS details,
 channel || ' initiated on ' || strftime(date, '%A %d %b %Y') || ' — ' || CAST(ends AS VARCHAR) || ' of ' || CAST(every AS VARCHAR) || ' other ' || channel || ' payments this period were on a weekend' AS text
 FROM (SELECT t.*, g.ends - 1 AS ends, g.every - 1 AS every FROM u t JOIN (SELECT run_id, channel, count(*) AS every, count(*) FILTER (WHERE isodow(date) >= 6) AS ends FROM i WHERE side = 'bank' AND amount < 0 GROUP BY run_id, channel) g
  ON g.run_id = t.run_id AND g.channel = t.channel WHERE t.side = 'bank' AND t.amount < 0 AND isodow(t.date) >= 6 AND t.channel IN ('RTGS', 'NEFT', 'IMPS'))""",
    "high_value": f"""SELECT run_id, id, CAST(0.6 AS DOUBLE) AS raw, '' AS evidence, 'amount=' || {_money("amount")} || ';threshold=300000.00' AS details, {_inr("amount")} || ' exceeds the ₹3,00,000.00 high-value threshold' AS text FROM u WHERE abs(amount) >= 300000""",
    "period_boundary": """SELECT run_id, id, CAST(0.35 AS DOUBLE) AS raw, o_id AS evidence, 'counterpart=' || o_id || ';daysAfterCutoff=' || CAST(after AS VARCHAR) AS details,
 CASE side WHEN 'bank' THEN 'Ledger entry ' || o_id || ' for the same amount is dated ' || strftime(o_date, '%d %b') ELSE 'Clears in bank on ' || strftime(o_date, '%d %b') || ' (' || o_id || ')' END || ' — ' || CAST(after AS VARCHAR) || ' day(s) after cut-off' AS text
 FROM (SELECT t.*, o.id AS o_id, o.date AS o_date, o.date - last_day(t.home) AS after, row_number() OVER (PARTITION BY t.run_id, t.id ORDER BY o.date, o.ord, o.id) AS n
  FROM (SELECT *, strptime(substr(run_id, 5, 7) || '-01', '%Y-%m-%d')::DATE AS home FROM u) t JOIN x o ON o.run_id = t.run_id AND o.side <> t.side AND o.amount = t.amount AND o.vendor = t.vendor
  AND last_day(t.home) - t.date <= 5 AND o.date - last_day(t.home) BETWEEN 1 AND 8) WHERE n = 1""",
    "amount_outlier": f"""SELECT run_id, id, round(least(0.9, 0.3 + 0.08 * (abs(z) - 3)), 5) AS raw, '' AS evidence,
 'historyCount=' || CAST(n AS VARCHAR) || ';median=' || {_money("med")} || ';robustZ=' || CAST(CASE WHEN z < 0 THEN ceil(z * 100 - 0.5) / 100 ELSE floor(z * 100 + 0.5) / 100 END AS VARCHAR) AS details,
 {_inr("amount")} || ' is ' || printf('%.1f', abs(z)) || ' robust SDs ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' this counterparty''s median of ' || {_inr("CAST(med AS DECIMAL(18,2))")} || ' (' || CAST(n AS VARCHAR) || ' prior txns)' AS text
 FROM (SELECT u.run_id, u.id, u.amount, k.n, k.med, 0.6745 * CAST(abs(u.amount) - med AS DOUBLE) / CAST(mad AS DOUBLE) AS z FROM u JOIN (
  SELECT run_id, side, vendor, n, med, CAST(quantile_cont(CAST(abs(a - med) AS DOUBLE), 0.5) AS DECIMAL(20,4)) AS mad FROM (SELECT run_id, side, vendor, abs(amount) AS a FROM h) JOIN (
   SELECT run_id, side, vendor, count(*) AS n, CAST(quantile_cont(CAST(abs(amount) AS DOUBLE), 0.5) AS DECIMAL(20,4)) AS med FROM h GROUP BY ALL HAVING count(*) >= 5) USING (run_id, side, vendor) GROUP BY ALL) k USING (run_id, side, vendor)) WHERE abs(z) >= 3""",
    "amount_mismatch": f"""SELECT run_id, id, CAST(0.45 AS DOUBLE) AS raw, o_id AS evidence, 'diff=' || {_money("gap")} || ';otherTxn=' || o_id AS details, CASE side WHEN 'bank' THEN 'Ledger ' ELSE 'Bank ' END || o_id || ' matches counterparty and date but differs by ' || {_inr("gap")} AS text
 FROM (SELECT t.*, o.id AS o_id, abs(t.amount - o.amount) AS gap, row_number() OVER (PARTITION BY t.run_id, t.id ORDER BY abs(t.amount - o.amount), o.ord, o.id) AS n FROM u t JOIN u o ON o.run_id = t.run_id AND o.side <> t.side AND o.vendor = t.vendor AND o.amount <> t.amount
  AND (o.amount < 0) = (t.amount < 0) AND abs(o.date - t.date) <= 3 AND abs(t.amount - o.amount) <= abs(t.amount) * 0.05) WHERE n = 1""",
    "round_amount": f"""SELECT run_id, id, CAST(0.3 AS DOUBLE) AS raw, '' AS evidence, CASE WHEN rest = 0 THEN 'roundTo=10000' ELSE 'gapToRound=' || {_money("10000 - rest")} END AS details,
 CASE WHEN rest = 0 THEN 'Round amount ' || {_inr("amount")} || ' on a vendor payment' ELSE 'Near-round amount (' || {_inr("10000 - rest")} || ' below ' || {_inr("abs(amount) + 10000 - rest")} || ')' END AS text
 FROM (SELECT *, abs(amount) % 10000 AS rest FROM u WHERE amount < 0 AND abs(amount) >= 10000) WHERE rest = 0 OR (rest >= 9500 AND abs(amount) % 100 = 0)""",
    "no_counterpart": """SELECT u.run_id, u.id, CASE WHEN c.near IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS raw, '' AS evidence, 'nearCandidates=' || CAST(coalesce(near, 0) AS VARCHAR) || ';side=' || CASE side WHEN 'bank' THEN 'ledger' ELSE 'bank' END AS details,
 CASE WHEN near IS NULL THEN 'No unmatched ' ELSE 'No exact-amount ' END || CASE side WHEN 'bank' THEN 'ledger entry' ELSE 'bank transaction' END || CASE WHEN near IS NULL THEN ' for this amount within ±7 days' ELSE '; ' || CAST(near AS VARCHAR) || ' near-amount candidate(s) within ±7 days' END AS text
 FROM u LEFT JOIN (SELECT t.run_id, t.id, count(*) AS near FROM u t JOIN u o ON o.run_id = t.run_id AND o.side <> t.side AND abs(o.date - t.date) <= 7 AND abs(o.amount - t.amount) <= abs(t.amount) * 0.2 GROUP BY t.run_id, t.id) c ON c.run_id = u.run_id AND c.id = u.id""",
}
_X = "x AS (SELECT * FROM txns WHERE external)"


def _signals(detector: str, more: str = "") -> str:
    """The SQL of one detector; ``more`` redefines tables below the names u2, x2, which then stand for u and x."""
    text = _DT[detector]
    for name in ("u", "x"):
        if f"{name}2 AS" in more:
            text = text.replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"FROM {name})", f"FROM {name}2)").replace(f"JOIN {name} ", f"JOIN {name}2 ")
    return f", {_HIST}, {_X}{more} {text}"


@query(_signals("duplicate_detector"))
def dt1_duplicate(spark, d):
    return flat(D.duplicate(State(spark, d).case))


@query(_signals("approval_limit"))
def dt2_approval_limit(spark, d):
    return flat(D.approval_limit(State(spark, d).case))


@query(_signals("new_vendor"))
def dt3_new_vendor(spark, d):
    return flat(D.new_vendor(State(spark, d).case))


@query(_signals("weekend_payment"))
def dt4_weekend_payment(spark, d):
    return flat(D.weekend_payment(State(spark, d).case))


@query(_signals("high_value"))
def dt5_high_value(spark, d):
    return flat(D.high_value(State(spark, d).case))


@query(_signals("period_boundary", ", u2 AS (SELECT * REPLACE (CAST(date - CAST(orderkey % 5 AS INT) AS DATE) AS date) FROM u), x2 AS (SELECT * REPLACE (CAST(date + CAST(orderkey % 7 AS INT) AS DATE) AS date) FROM x)"))
def dt6_period_boundary(spark, d):
    """Rows some days earlier and out-of-period rows some days later than in the fixture, so that both bounds matter."""
    case = State(spark, d).case
    case.unmatched = case.unmatched.withColumn("date", F.date_sub("date", (F.col("orderkey") % 5).cast("int")))
    case.external = case.external.withColumn("date", F.date_add("date", (F.col("orderkey") % 7).cast("int")))
    return flat(D.period_boundary(case))


@query(_signals("amount_outlier"))
def dt7_amount_outlier(spark, d):
    return flat(D.amount_outlier(State(spark, d).case)).withColumn("raw", F.round("raw", 5))


@query(_signals("amount_mismatch"))
def dt8_amount_mismatch(spark, d):
    return flat(D.amount_mismatch(State(spark, d).case))


@query(_signals("round_amount", ", u2 AS (SELECT * REPLACE (CAST(round(amount / 5000) * 5000 + CASE WHEN orderkey % 3 = 0 THEN 300 ELSE 0 END AS DECIMAL(18,2)) AS amount) FROM u)"))
def dt9_round_amount(spark, d):
    case = State(spark, d).case
    amount = F.round(F.col("amount") / 5000, 0) * 5000 + F.when(F.col("orderkey") % 3 == 0, 300).otherwise(0)
    case.unmatched = case.unmatched.withColumn("amount", amount.cast("decimal(18,2)"))
    return flat(D.round_amount(case))


_SHIFT = ", v AS (SELECT * REPLACE (CASE WHEN side = 'ledger' THEN 'acc9' ELSE account_id END AS account_id) FROM i)"


@query(f"""{_SHIFT}, x AS (SELECT t.run_id, t.id, o.id AS o_id, row_number() OVER (PARTITION BY t.run_id, t.id ORDER BY abs(o.date - t.date), o.id) AS n FROM v t JOIN v o ON o.run_id = t.run_id AND o.side <> t.side AND o.account_id <> t.account_id AND o.amount = t.amount AND o.vendor = t.vendor AND abs(o.date - t.date) <= 3)
SELECT run_id, id, o_id FROM x WHERE n = 1""")
def dt10_cross_account(spark, d):
    s = State(spark, d)
    # every row is open, and ledger rows name another account
    case = s.case
    case.unmatched = s.txns.withColumn("account_id", F.when(F.col("side") == "ledger", "acc9").otherwise(F.col("account_id")))
    case.runs = s.runs.withColumn("same_account", F.lit(True))
    return D.cross_account(case).select("run_id", "id", "o_id")


@query(_signals("no_counterpart"))
def dt11_no_counterpart(spark, d):
    return flat(D.no_counterpart(State(spark, d).case))


_WEIGHTS = {"duplicate_detector": 1, "approval_limit": 1, "new_vendor": 0.9, "weekend_payment": 0.8, "high_value": 0.7, "period_boundary": 0.5, "amount_outlier": 0.6, "amount_mismatch": 1.0, "round_amount": 0.3, "no_counterpart": 0.5}
_ALL = " UNION ALL ".join(f"SELECT run_id, id, '{k}' AS detector, {i} AS place, raw, CAST({w} AS DOUBLE) AS weight, evidence, details, text FROM ({_DT[k]})" for i, (k, w) in enumerate(_WEIGHTS.items()))
_SCORED = f", {_HIST}, {_X}, sg AS (SELECT *, floor(raw * weight * 1000 + 0.5) / 1000 AS score FROM ({_ALL}))"


@query(f"{_SCORED} SELECT run_id, id, detector, round(raw, 5) AS raw, round(score, 3) AS score, text FROM sg")
def dt12_all_signals(spark, d):
    return D.run_detectors(State(spark, d).case).select("run_id", "id", "detector", F.round("raw", 5).alias("raw"), F.round("score", 3).alias("score"), "text")


@query("""SELECT run_id, id, floor((1 - (1 - 0.5) * (1 - CAST(orderkey % 10 AS DOUBLE) / 10)) * 1000 + 0.5) / 1000 AS risk, CASE WHEN orderkey % 10 >= 7 THEN 'critical' WHEN orderkey % 10 >= 4 THEN 'high' ELSE 'medium' END AS level FROM u""")
def dt13_risk(spark, d):
    rows = State(spark, d).unmatched.select("run_id", "id", F.array(F.lit(0.5), (F.col("orderkey") % 10).cast("double") / 10).alias("scores"))
    value = D.half_up(D.risk(F.col("scores")), 3)
    return rows.select("run_id", "id", value.alias("risk"), D.risk_level(value).alias("level"))


_RULES = Rules(classify=(Classify("R-1", "^nach", "missing", Decimal("100000")), Classify("R-2", "^(Nach|upi)", "timing")))
_CLASS = "CASE WHEN channel = 'NACH' AND abs(amount) <= 100000 THEN 'R-1' WHEN channel IN ('NACH', 'UPI') THEN 'R-2' END"


@query(f"SELECT run_id, id, {_CLASS} AS class_rule FROM u")
def dt14_classify_rules(spark, d):
    return G.classified_by_rule(State(spark, d).unmatched, _RULES).select("run_id", "id", "class_rule")


@query(f"""{_SCORED}, k AS (SELECT run_id, id, {_CLASS} AS rule FROM u) SELECT run_id, id, detector, round(raw, 5) AS raw, round(score, 3) AS score, text FROM sg WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.run_id = sg.run_id AND k.id = sg.id AND rule IS NOT NULL)
UNION ALL SELECT run_id, id, 'no_counterpart', 0.3, 0.15, 'No ledger entry; classified by an approved rule' FROM k WHERE rule IS NOT NULL""")
def dt14_rule_signals(spark, d):
    _, signals = G.signals_of(State(spark, d).case, _RULES)
    return signals.select("run_id", "id", "detector", F.round("raw", 5).alias("raw"), F.round("score", 3).alias("score"), "text")


#: Stored rules of the kinds that a run may have; the pattern of the first has a group that only Python can name.
_STORED = [
    {"id": "R-7", "name": "Mandates", "description": "Small mandates have no voucher.", "params": {"pattern": "^(?P<kind>NACH)-", "category": "missing", "maxAmount": "1,00,000", "suggestedGl": "4410"}},
    {"id": "R-8", "name": "Broken", "description": "", "params": {"pattern": "(upi", "category": "timing"}},
    {"id": "R-9", "name": "Wallets", "description": "Clears later.", "params": {"pattern": "^(nach|upi)[-/]", "category": "timing"}},
    {"id": "R-10", "enabled": False, "params": {"pattern": ".", "category": "duplicate"}},
]


@query(f"""SELECT run_id, id, rule AS class_rule, CASE rule WHEN 'R-7' THEN 'missing' ELSE 'timing' END AS category, CASE rule WHEN 'R-7' THEN 'Post to GL 4410.' ELSE 'Book per rule.' END AS suggested_action,
CASE rule WHEN 'R-7' THEN ' matches approved rule R-7 “Mandates”. Small mandates have no voucher.' ELSE ' matches approved rule R-9 “Wallets”. Clears later.' END AS told, 0.95::DOUBLE AS confidence, 0.15::DOUBLE AS risk_score,
CASE WHEN abs(amount) >= high_value THEN 'human_review' ELSE 'auto_resolve' END AS routing, CASE WHEN abs(amount) >= high_value THEN 'High value' END AS routing_reason
FROM (SELECT u.*, r.high_value, CASE WHEN channel = 'NACH' AND abs(amount) <= 100000 THEN 'R-7' WHEN channel IN ('NACH', 'UPI') THEN 'R-9' END AS rule FROM u JOIN runs r USING (run_id)) WHERE rule IS NOT NULL""")
def dt14_rule_findings(spark, d):
    """Findings of the rows that stored rules classify, among all findings."""
    s = State(spark, d)
    found = G.investigate(s.case, compile_rules(_STORED, {}).rules, s.runs).where("class_rule is not null and size(covered) = 1")
    told = F.regexp_extract("explanation", r"\)( matches approved rule .*)$", 1)
    return found.select("run_id", "id", "class_rule", "category", "suggested_action", told.alias("told"), "confidence", F.round("risk_score", 3).alias("risk_score"), "routing", "routing_reason")


def _made(spark, d):
    s = State(spark, d)
    signals = D.run_detectors(s.case)
    from reckon.durable import stash

    signals = stash(signals, "signals")
    return s, signals, G.cover(s.unmatched, signals)


@query()
def dt15_findings(spark, d):
    _, _, covered = _made(spark, d)
    return covered.select("run_id", "id", F.array_join("covered", ",").alias("covered"))


@query()
def cl1_cl2_cl3_classified(spark, d):
    s, signals, covered = _made(spark, d)
    rows = covered.join(s.unmatched, ["run_id", "id"]).join(D.scored_rows(signals), ["run_id", "id"]).join(s.runs.select("run_id", "high_value"), "run_id")
    out = G.explained(rows)
    routing, reason = G.route(F.col("category"), F.col("confidence"), F.col("amount"), F.col("high_value"))
    return out.select("run_id", "id", "category", "confidence", "risk_score", "risk_level", "explanation", "suggested_action", routing.alias("routing"), reason.alias("routing_reason"))


def _judged(threshold: str = "300000") -> str:
    """Names of a row's detectors, its category and confidence as SQL, at a threshold of high values."""
    scored = _SCORED if threshold == "300000" else _SCORED.replace("abs(amount) >= 300000", f"abs(amount) >= {threshold}")
    has = lambda x: f"list_contains(names, '{x}')"
    fraud = f"({has('approval_limit')} OR ({has('weekend_payment')} AND ({has('high_value')} OR {has('new_vendor')})) OR ({has('new_vendor')} AND {has('round_amount')} AND {has('high_value')}))"
    return f"""{scored}, g AS (SELECT run_id, id, list(detector) AS names, list(score ORDER BY place) AS scores FROM sg GROUP BY run_id, id),
c AS (SELECT *, CASE WHEN {has('duplicate_detector')} THEN 'duplicate' WHEN {fraud} THEN 'potential_fraud' WHEN {has('period_boundary')} THEN 'timing' WHEN {has('amount_mismatch')} OR {has('new_vendor')} THEN 'unknown' ELSE 'missing' END AS category, {has('amount_mismatch')} AS gap FROM g),
j AS (SELECT c.*, u.amount, CASE WHEN category IN ('duplicate', 'timing') THEN 0.6 WHEN category = 'potential_fraud' THEN 0.55 WHEN gap THEN 0.5 WHEN category = 'unknown' THEN 0.45 ELSE 0.55 END AS confidence,
 floor((1 - list_reduce(list_prepend(CAST(1 AS DOUBLE), scores), lambda x, y: x - x * y)) * 1000 + 0.5) / 1000 AS risk FROM c JOIN u USING (run_id, id))"""


@query(f"""{_judged()} SELECT run_id, id, category, CAST(confidence AS DOUBLE) AS confidence, round(risk, 3) AS risk_score, CASE WHEN risk >= 0.85 THEN 'critical' WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
 'human_review' AS routing, CASE WHEN category = 'potential_fraud' THEN 'Potential fraud' WHEN abs(amount) >= 300000 THEN 'High value' ELSE 'Low AI confidence' END AS routing_reason FROM j""")
def cl1_cl3_open_rows(spark, d):
    """Category, confidence, risk and routing of every open row."""
    s = State(spark, d)
    from reckon.durable import stash

    rows = s.unmatched.join(D.scored_rows(stash(D.run_detectors(s.case), "signals")), ["run_id", "id"]).join(s.runs.select("run_id", "high_value"), "run_id")
    out = G.explained(rows)
    routing, reason = G.route(F.col("category"), F.col("confidence"), F.col("amount"), F.col("high_value"))
    return out.select("run_id", "id", "category", "confidence", F.round("risk_score", 3).alias("risk_score"), "risk_level", routing.alias("routing"), reason.alias("routing_reason"))


_REVIEW = "CASE WHEN category IN ('potential_fraud', 'unknown') OR abs(amount) >= 300000 THEN 1 ELSE 0 END"


@query(f"""{_judged("200000")}, w AS (SELECT run_id, id, {_REVIEW} AS now FROM j) SELECT run_id, CAST(sum(w.now - o.was) AS BIGINT) AS change FROM w JOIN (WITH {"h" + _HIST[1:]}, {_X}, {_judged().partition(_X + ", ")[2]} SELECT run_id, id, {_REVIEW} AS was FROM j) o USING (run_id, id) GROUP BY run_id""")
def cl6_review_change(spark, d):
    """Rows sent to review if high values began at 200 000 for the detector, while review itself keeps its bound."""
    s = State(spark, d)
    from reckon.durable import stash

    names = ("run_id", "id", "detector")
    before = stash(D.run_detectors(s.case).select(*names), "signals")
    case = s.case
    case.runs = s.runs.withColumn("high_value", F.lit(200000).cast("decimal(18,2)"))
    after = stash(D.run_detectors(case).select(*names), "signals")
    return G.review_change(before, after, s.unmatched.join(s.runs.select("run_id", "high_value"), "run_id"))


@query("""SELECT run_id, coalesce(sum(amount) FILTER (WHERE side = 'bank'), 0)::DECIMAL(28,2) AS bank_total, coalesce(sum(amount) FILTER (WHERE side = 'ledger'), 0)::DECIMAL(28,2) AS ledger_total,
(coalesce(sum(amount) FILTER (WHERE side = 'bank'), 0) - coalesce(sum(amount) FILTER (WHERE side = 'ledger'), 0))::DECIMAL(28,2) AS difference, count(*) FILTER (WHERE open_) AS open_rows, true AS covered_once
FROM (SELECT i.*, EXISTS (SELECT 1 FROM u WHERE u.run_id = i.run_id AND u.id = i.id) AS open_ FROM i) GROUP BY run_id""")
def cl4_coverage_proof(spark, d):
    s = State(spark, d)
    return G.coverage_proof(s.unmatched, s.findings, s.txns).withColumn("difference", F.col("difference").cast("decimal(28,2)"))


@query("""SELECT run_id, account_id, CAST(1000 AS DECIMAL(28,2)) AS opening, sum(amount)::DECIMAL(28,2) AS total, (1000 + sum(amount))::DECIMAL(28,2) AS closing, true AS agrees FROM i WHERE side = 'bank' GROUP BY run_id, account_id""")
def cl5_statement_sanity(spark, d):
    from pyspark.sql import Window as W

    rows = fixture.inside(spark, d).where("side = 'bank'")
    upto = F.sum("amount").over(W.partitionBy("run_id", "account_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return G.statement_sanity(rows.withColumn("balance", upto + 1000), ["run_id", "account_id"])


@query("""SELECT run_id, count(*) FILTER (WHERE abs(amount) >= 300000) AS flagged_now, count(*) FILTER (WHERE abs(amount) >= 200000) AS flagged_after, count(*) FILTER (WHERE abs(amount) >= 200000 AND abs(amount) < 300000) AS newly,
CAST(0 AS BIGINT) AS cleared FROM u WHERE abs(amount) >= 200000 GROUP BY run_id""")
def cl6_detector_dry_run(spark, d):
    s = State(spark, d)
    case = s.case
    before = D.high_value(case)
    case.runs = s.runs.withColumn("high_value", F.lit(200000).cast("decimal(18,2)"))
    return G.detector_dry_run(before, D.high_value(case), s.unmatched).drop("samples")


@query("""SELECT run_id, count(*) FILTER (WHERE open_) AS open_rows, CAST(right(run_id, 1) AS INT) % 3 = 0 OR count(*) FILTER (WHERE open_) = 0 AS covered_once
FROM (SELECT i.*, EXISTS (SELECT 1 FROM u WHERE u.run_id = i.run_id AND u.id = i.id) AS open_ FROM i) GROUP BY run_id""")
def cl4_broken_coverage(spark, d):
    """The proof fails where a finding loses a row (a third of the runs) or a row has two findings (another third)."""
    s = State(spark, d)
    kind = F.right("run_id", F.lit(1)).cast("int") % 3
    first = s.unmatched.groupBy("run_id").agg(F.min("id").alias("first"))
    found = s.findings.select("run_id", "covered").join(first, "run_id")
    lost = found.select("run_id", F.when(kind == 1, F.array_remove("covered", F.col("first"))).otherwise(F.col("covered")).alias("covered"))
    twice = first.where(kind == 2).select("run_id", F.array("first").alias("covered"))
    return G.coverage_proof(s.unmatched, lost.unionByName(twice), s.txns).select("run_id", "open_rows", "covered_once")


@query("""SELECT run_id, account_id, CAST(1000 AS DECIMAL(28,2)) AS opening, sum(amount)::DECIMAL(28,2) AS total, (1000 + sum(amount) + CASE WHEN account_id = 'acc1' AND count(*) > 1 THEN 1 ELSE 0 END)::DECIMAL(28,2) AS closing,
account_id <> 'acc1' OR count(*) = 1 AS agrees FROM i WHERE side = 'bank' GROUP BY run_id, account_id""")
def cl5_broken_statement(spark, d):
    """Statements of one account whose balances are one too high from the second row on."""
    from pyspark.sql import Window as W

    rows = fixture.inside(spark, d).where("side = 'bank'")
    own = W.partitionBy("run_id", "account_id").orderBy("ord")
    upto = F.sum("amount").over(own.rowsBetween(W.unboundedPreceding, 0))
    off = F.when((F.col("account_id") == "acc1") & (F.row_number().over(own) > 1), 1).otherwise(0)
    return G.statement_sanity(rows.withColumn("balance", upto + 1000 + off), ["run_id", "account_id"])


@query("""SELECT run_id, coalesce(string_agg(id, ',' ORDER BY n) FILTER (WHERE amount_now AND n <= 3), '') AS samples FROM (SELECT *, abs(amount) < 300000 AS amount_now, row_number() OVER (PARTITION BY run_id ORDER BY abs(amount) >= 300000, ord, id) AS n
FROM u WHERE abs(amount) >= 200000) GROUP BY run_id""")
def cl6_dry_run_samples(spark, d):
    """The first three rows of each run that a lower bound of high values newly flags."""
    s = State(spark, d)
    case = s.case
    before = D.high_value(case)
    case.runs = s.runs.withColumn("high_value", F.lit(200000).cast("decimal(18,2)"))
    return G.detector_dry_run(before, D.high_value(case), s.unmatched).select("run_id", F.array_join("samples", ",").alias("samples"))
