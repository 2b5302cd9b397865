import datetime as dt

from pyspark.sql import functions as F

from reckon.operators import views as V


def stats(spark, rows):
    out = [(r, p, s, dt.datetime.fromisoformat(c), rate, m, float(u), *(n,) * 5) for r, p, s, c, rate, m, u, n in rows]
    kinds = ", ".join(f"n_{c} long" for c in V.CATEGORIES)
    df = spark.createDataFrame(out, f"run_id string, period string, status string, created_at timestamp, auto_match_rate double, matched long, unexplained double, {kinds}")
    return df.withColumn("unexplained", F.col("unexplained").cast("decimal(28,2)"))


def findings(spark, rows):
    return spark.createDataFrame(rows, "status string, routing string")


def now():
    return F.lit("2026-09-20").cast("timestamp")


def test_the_last_run_of_a_period_is_the_one_created_last(spark):
    s = stats(spark, [
        ("run_z", "2026-08", "completed", "2026-09-01", 0.5, 100, -10, 1), ("run_a", "2026-08", "awaiting_review", "2026-09-07", 0.8, 200, -20.5, 2),
        ("run_f", "2026-09", "failed", "2026-09-09", 0.1, 10, 5, 3), ("run_q", "2026-10", "queued", "2026-10-01", 0.0, 0, 7, 4), ("run_o", "2025-09", "awaiting_review", "2025-09-09", 0.4, 50, 30, 5),
    ])
    f = findings(spark, [("open", "human_review"), ("open", "auto_resolve"), ("approved", "human_review"), ("escalated", "human_review")])
    row = V.dashboard(s, f, now()).first().asDict()
    assert {**row, "unreconciled_amount": float(row["unreconciled_amount"])} == {"runs_this_month": 3, "auto_match_rate": 0.8, "open_anomalies": 3, "pending_reviews": 2, "unreconciled_amount": 50.5, "avg_hours_saved": 2.5}
    assert {(r.period, r.run_id) for r in V.trend_by_period(s).collect()} == {("2026-08", "run_a"), ("2025-09", "run_o")}
    got = {(r.level, r.period, r.category): (r.findings, r.auto_match_rate) for r in V.dashboard_trend(s).collect()}
    assert got["period", "2026-08", None] == (10, 0.8) and got["all", None, None] == (35, None) and got["category", "2025-09", "timing"] == (5, None) and len(got) == 13


def test_twelve_periods_and_none(spark):
    s = stats(spark, [(f"run_{i}", f"{2024 + i // 12}-{i % 12 + 1:02d}", "completed", f"{2024 + i // 12}-{i % 12 + 1:02d}-05", i / 100, 50 * i, 0, i) for i in range(30)])
    f = findings(spark, [])
    row = V.dashboard(s, f, now()).first()
    assert row.avg_hours_saved == 23.5 and row.auto_match_rate == 0.29 and row.open_anomalies == 0
    assert sorted(r.period for r in V.dashboard_trend(s).where("level = 'period'").collect())[0] == "2025-07"
    none = V.dashboard(s.limit(0), f, now()).first()
    assert (none.runs_this_month, none.auto_match_rate, none.avg_hours_saved, none.unreconciled_amount) == (0, 0.0, 0.0, 0)
    assert V.dashboard_trend(s.limit(0)).count() == 0
