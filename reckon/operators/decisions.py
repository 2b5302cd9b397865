"""Decisions of reviewers on findings and pairs, applied as logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reckon.operators.matching import score_groups
from reckon.operators.views import OPEN, pair_rows

ACTIONS = ("approve", "change_category", "reject", "escalate", "false_positive", "reopen")


def refusal(action: Column, reason: Column, new_category: Column, category: Column, amount: Column, high_value: Column, run_status: Column) -> Column:
    """Why a decision cannot be applied, or null."""
    short = F.length(F.trim(F.coalesce(reason, F.lit("")))) < 5
    weighty = ((category == "potential_fraud") | (F.abs(amount) >= high_value)) & action.isin("approve", "change_category", "false_positive")
    return (
        F.when(~action.isin(*ACTIONS), "unknown action").when((action == "reject") & short, "reason required").when(weighty & short, "notes required")
        .when((action == "change_category") & new_category.isNull(), "category required").when(run_status == "completed", "run finalized")
    )


def decide(findings: DataFrame, txns: DataFrame, runs: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings after an ordered log of decisions, and the decisions refused with their reason.

    The log has (run_id, finding_id, seq, action, reason, new_category). Each finding folds its own decisions in
    the order of seq: reopening returns to the status before, others are remembered as the one before.
    """
    facts = findings.join(txns.select("run_id", "id", "amount"), ["run_id", "id"]).join(runs.select("run_id", "high_value", F.col("status").alias("run_status")), "run_id")
    why = refusal(F.col("action"), F.col("reason"), F.col("new_category"), F.col("category"), F.col("amount"), F.col("high_value"), F.col("run_status"))
    judged = log.join(facts.select("run_id", "finding_id", "category", "amount", "high_value", "run_status"), ["run_id", "finding_id"], "left")
    judged = judged.withColumn("refused", F.when(F.col("category").isNull(), "no such finding").otherwise(why))
    steps = judged.where("refused is null").groupBy("run_id", "finding_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "new_category"))).alias("steps"))
    rows = findings.join(steps, ["run_id", "finding_id"], "left")
    text = lambda c: c.cast("string")
    start = F.struct(
        text(F.col("status")).alias("status"), text(F.col("prev_status")).alias("prev"), text(F.col("human_category")).alias("human"),
        F.coalesce("false_positive", F.lit(False)).alias("wrong"), text(F.col("assignee")).alias("assignee"),
    )

    def fold(now: Column, step: Column) -> Column:
        a = step["action"]
        back = F.when(now["prev"].isNotNull() & (now["prev"] != now["status"]), now["prev"]).otherwise("open")
        status = F.when(a.isin("approve", "change_category", "false_positive"), "approved").when(a == "reject", "rejected").when(a == "escalate", "escalated").otherwise(back)
        return F.struct(
            status.alias("status"), now["status"].alias("prev"), F.when(a == "reopen", F.lit(None).cast("string")).when(a == "change_category", step["new_category"]).otherwise(now["human"]).alias("human"),
            F.when(a == "false_positive", True).when(a == "reopen", False).otherwise(now["wrong"]).alias("wrong"), F.when(a == "escalate", "escalation").otherwise(now["assignee"]).alias("assignee"),
        )

    rows = rows.withColumn("end", F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), start, fold))
    changed = {"status": "status", "prev_status": "prev", "human_category": "human", "false_positive": "wrong", "assignee": "assignee"}
    out = rows.select(*[F.col("end")[changed[c]].alias(c) if c in changed else F.col(c) for c in findings.columns])
    return out, judged.where("refused is not null").select("run_id", "finding_id", "seq", "action", "refused")


def bulk_approve(findings: DataFrame, txns: DataFrame, runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Findings after approving those asked for (run_id, finding_id) that are open, no fraud and below the high value."""
    may = findings.join(asked.distinct(), ["run_id", "finding_id"], "left_semi").join(txns.select("run_id", "id", "amount"), ["run_id", "id"]).join(runs.select("run_id", "high_value"), "run_id")
    may = may.where(F.col("status").isin(*OPEN) & (F.col("category") != "potential_fraud") & (F.abs("amount") < F.col("high_value"))).select("run_id", "finding_id", F.lit(True).alias("go"))
    rows = findings.join(may, ["run_id", "finding_id"], "left")
    new = {"status": F.when(F.col("go"), "approved").otherwise(F.col("status")), "prev_status": F.when(F.col("go"), F.col("status")).otherwise(F.col("prev_status"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in findings.columns])


def finalize_gate(stats: DataFrame, findings: DataFrame) -> DataFrame:
    """Per run: open findings, unexplained difference, and whether it may be finalised."""
    open_ = findings.where(F.col("status").isin(*OPEN)).groupBy("run_id").agg(F.count(F.lit(1)).alias("open_findings"))
    out = stats.select("run_id", "unexplained").join(open_, "run_id", "left").fillna(0, ["open_findings"])
    return out.withColumn("may_finalize", (F.col("open_findings") == 0) & (F.col("unexplained") == 0))


def manual_match(asked: DataFrame, txns: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored pairs (status manual) of the valid requests (run_id, bank_ids, ledger_ids), and those refused with a reason.

    Every id must exist on its side, stand in no pair and in one request only.
    """
    asked = asked.withColumn("ask", F.concat_ws("\u0001", "run_id", F.array_join("bank_ids", ","), F.array_join("ledger_ids", ",")))
    ids = asked.select("run_id", "ask", F.lit("bank").alias("side"), F.explode_outer("bank_ids").alias("id")).unionAll(asked.select("run_id", "ask", F.lit("ledger").alias("side"), F.explode_outer("ledger_ids").alias("id")))
    known = txns.select("run_id", "side", "id", F.lit(True).alias("known"))
    taken = pair_rows(pairs).select("run_id", "id").distinct().withColumn("taken", F.lit(True))
    times = ids.groupBy("run_id", "id").agg(F.countDistinct("ask").alias("asks"))
    checked = ids.join(known, ["run_id", "side", "id"], "left").join(taken, ["run_id", "id"], "left").join(times, ["run_id", "id"], "left")
    reason = F.when(F.col("id").isNull() | F.col("known").isNull(), "unknown row").when(F.col("taken"), "already matched").when(F.col("asks") > 1, "asked for twice")
    bad = checked.withColumn("refused", reason).where("refused is not null").groupBy("ask").agg(F.min("refused").alias("refused"))
    good = asked.join(bad, "ask", "left_anti").drop("ask")
    made = score_groups(good, txns, "Manual", None).withColumn("status", F.lit("manual"))
    return made, asked.join(bad, "ask").drop("ask")


def unmatch(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs without those asked for (run_id, pair_id)."""
    return pairs.join(asked, ["run_id", "pair_id"], "left_anti")


def settle_touched(findings: DataFrame, pairs: DataFrame, status: str) -> DataFrame:
    """Findings after their open ones that cover a row of new pairs got a status (auto_resolved or approved)."""
    hit = findings.where(F.col("status").isin(*OPEN)).select("run_id", "finding_id", F.explode("covered").alias("id")).join(pair_rows(pairs).select("run_id", "id").distinct(), ["run_id", "id"], "left_semi")
    rows = findings.join(hit.select("run_id", "finding_id").distinct().withColumn("hit", F.lit(True)), ["run_id", "finding_id"], "left")
    new = {"status": F.when(F.col("hit"), status).otherwise(F.col("status")), "prev_status": F.when(F.col("hit"), F.col("status")).otherwise(F.col("prev_status"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in findings.columns])
