"""Report rows, and their writing as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.operators.views import OPEN, pair_view, unmatched_view


def money_text(amount: Column) -> Column:
    return amount.cast("decimal(28,2)").cast("string")


def number_text(value: Column) -> Column:
    """A double as text: whole numbers without a point, others in full."""
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def reconciled_ledger(txns: DataFrame, pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs and unmatched rows of each run in the fourteen columns of the reconciled ledger."""
    gl = F.col("gl_code") if "gl_code" in txns.columns else F.lit(None).cast("string")
    facts = txns.withColumn("gl", gl)
    p = pair_view(pairs, facts).withColumn("gl_code", F.coalesce("ledger_gl", F.lit("")))
    matched = p.select(
        "run_id", F.col("pair_id").alias("match_id"), F.col("pass_name").alias("pass"), number_text(F.col("score")).alias("confidence"), "status", F.array_join("bank_ids", " ").alias("bank_ids"),
        F.col("bank_date").cast("string").alias("bank_date"), "bank_description", money_text(F.col("bank_amount")).alias("bank_amount"), F.array_join("ledger_ids", " ").alias("ledger_ids"),
        F.col("ledger_date").cast("string").alias("ledger_date"), "ledger_vendor", "gl_code", money_text(F.col("ledger_amount")).alias("ledger_amount"), money_text(F.col("amount_diff")).alias("difference"),
    )
    u = unmatched_view(facts, pairs, findings)
    only = lambda s, c: F.when(F.col("side") == s, c.cast("string")).otherwise("")
    free = u.select(
        "run_id", F.lit("").alias("match_id"), F.lit("UNMATCHED").alias("pass"), F.lit("").alias("confidence"), F.coalesce("category", F.lit("unclassified")).alias("status"),
        only("bank", F.col("id")).alias("bank_ids"), only("bank", F.col("date")).alias("bank_date"), only("bank", F.col("narration")).alias("bank_description"), only("bank", money_text(F.col("amount"))).alias("bank_amount"),
        only("ledger", F.col("id")).alias("ledger_ids"), only("ledger", F.col("date")).alias("ledger_date"), only("ledger", F.col("vendor")).alias("ledger_vendor"), F.coalesce("gl", F.lit("")).alias("gl_code"),
        only("ledger", money_text(F.col("amount"))).alias("ledger_amount"), F.lit("").alias("difference"),
    )
    return matched.unionByName(free)


def finding_rows(findings: DataFrame, txns: DataFrame, unresolved_only: bool = False, explanations: bool = False, with_evidence: bool = False) -> DataFrame:
    """Findings of each run as report rows, optionally only open ones, with explanations and evidence."""
    rows = findings.where(F.col("status").isin(*OPEN)) if unresolved_only else findings
    rows = rows.join(txns.select("run_id", "id", "date", "narration", "amount"), ["run_id", "id"])
    cols = [
        "run_id", "finding_id", F.col("id").alias("txn_id"), F.col("date").cast("string").alias("date"), F.col("narration").alias("description"), money_text(F.col("amount")).alias("amount"),
        F.coalesce("human_category", "category").alias("category"), number_text(F.col("risk_score")).alias("risk"), number_text(F.col("confidence")).alias("ai_confidence"), "status", F.coalesce("assignee", F.lit("")).alias("assignee"),
    ]
    if explanations:
        cols += [F.col("explanation").alias("ai_explanation"), "suggested_action", F.concat_ws("@", "model_name", "model_version").alias("model")]
    if with_evidence:
        cols += [F.array_join("evidence", " ").alias("evidence_ids"), F.array_join(F.transform("signals", lambda s: s["text"]), " | ").alias("signals")]
    return rows.select(*cols)


def audit_rows(log: DataFrame, run_id: str | None = None) -> DataFrame:
    """The audit trail, newest first; before and after stand as compact JSON, a missing one as an empty JSON string."""
    out = log.where(F.col("run_id") == run_id) if run_id else log
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit('""'))
    rows = out.orderBy(F.desc("ts"), F.desc("seq"))
    return rows.select("id", F.col("ts").cast("string").alias("timestamp"), "actor_type", F.col("actor_name").alias("actor"), "action", "target", text("before").alias("before"), text("after").alias("after"), F.coalesce("model_version", F.lit("")).alias("model_version"), F.coalesce("ip", F.lit("")).alias("ip"))


def csv_cells(rows: DataFrame) -> DataFrame:
    """Every column as the text of a CSV cell: null empty, whole doubles without a point."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        text = number_text(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(f.name))
    return rows.select(*out)


def csv_line(rows: DataFrame) -> DataFrame:
    """Rows as CSV lines: a cell is quoted only if it holds a quote, comma or line feed, and quotes are doubled."""
    cells = csv_cells(rows)
    quoted = [F.when(F.col(f"`{c}`").rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(F.col(f"`{c}`"), '"', '""'), F.lit('"'))).otherwise(F.col(f"`{c}`")) for c in cells.columns]
    return cells.select(F.concat_ws(",", *quoted).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Write report rows as CSV files with the header of the columns, every partition by its own task."""
    csv_cells(rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def run_export(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Run summaries as a flat table."""
    accounts = runs.select("run_id", F.array_join("accounts", " ").alias("accounts")) if "accounts" in runs.columns else runs.select("run_id", F.lit("").alias("accounts"))
    return stats.join(accounts, "run_id").select("run_id", "period", "status", "accounts", "bank_count", "ledger_count", "matched", "auto_match_rate", "unmatched_bank", "unmatched_ledger", "anomalies", money_text(F.col("unexplained")).alias("unexplained"))
