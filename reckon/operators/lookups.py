"""Investigation lookups, in batch: each takes focus rows (run_id, id, side, date, amount, vendor, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reckon.durable import stash
from reckon.functions.scalars import month_start
from reckon.functions.similarity import with_similarity
from reckon.operators.detectors import banded
from reckon.operators.matching import day_number, near_join
from reckon.operators.medians import counted_amounts, histograms_before, middles_before
from reckon.operators.name_join import similar_pairs


def _other(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", *[F.col(c).alias(f"o_{c}") for c in ("id", "side", "date", "amount", "vendor", "ord")])


#: Shares of an amount within which its nearest rows are looked for in turn, up to the quarter that a search reaches.
REACHES = (0.0002, 0.001, 0.005, 0.025, 0.1, 0.25)


def search_other_side(focus: DataFrame, pool: DataFrame, top: int = 8, days: int = 7, alike_first: bool = True) -> DataFrame:
    """Rows of the other side within days whose amount is within a quarter or whose vendor is similar (.8; .6 where
    the focus has no amount), nearest amount first, then the most similar vendor (unless not ``alike_first``), then ord and id.

    Rows of nearer amounts come first whatever their vendor, so a focus that has ``top`` of them within a small share of its
    amount is done; only the others look further, and only those with fewer within the quarter ask for all similar vendors.
    """
    t = focus.select("run_id", "id", "side", "date", "amount", "vendor").withColumn("o_side", F.when(F.col("side") == "bank", "ledger").otherwise("bank"))
    others, gap = _other(pool), F.abs(F.col("o_amount") - F.col("amount"))
    own = W.partitionBy("run_id", "id")
    left, parts = t, []
    for share in REACHES:
        near = banded(left, others, share, days).withColumn("at", F.rank().over(own.orderBy(gap))).where(F.col("at") <= top)
        near = stash(near.withColumn("found", F.count(F.lit(1)).over(own)), "search-near")
        last = share == REACHES[-1]
        parts.append((near if last else near.where(F.col("found") >= top)).drop("at", "found"))
        left = left.join(near.where(F.col("found") >= top).select("run_id", "id").distinct(), ["run_id", "id"], "left_anti")
        left = stash(left, "search-left")
    keys = ["run_id", "o_side"]
    met = t.select(*keys, "vendor").distinct().join(others.select(*keys, "o_vendor").distinct(), keys).select("vendor", "o_vendor").distinct()
    names = stash(with_similarity(met, "vendor", "o_vendor").where("similarity >= 0.6"), "search-names")
    apart = [(day_number(F.col("date")), day_number(F.col("o_date")), days)]
    # rows without an amount count as nearest, so every focus asks for those of similar vendors
    blank = near_join(t.join(names, "vendor"), others.where("o_amount is null"), [*keys, "o_vendor"], apart)
    named = near_join(left.join(names, "vendor"), others.where("o_amount is not null"), [*keys, "o_vendor"], apart).unionByName(blank)
    within = F.coalesce(gap <= F.abs("amount") * F.lit("0.25").cast("decimal(3,2)"), F.lit(False))
    parts.append(named.where(~within & (F.col("similarity") >= F.when(F.col("amount").isNull(), 0.6).otherwise(0.8))).drop("similarity"))
    near = with_similarity(reduce(DataFrame.unionByName, parts), "vendor", "o_vendor")
    rank = F.row_number().over(own.orderBy(F.coalesce(gap, F.lit(0)), *[F.desc("similarity")][: int(alike_first)], "o_ord", "o_id"))
    return near.withColumn("gap", (F.col("o_amount") - F.col("amount")).cast("decimal(18,2)")).withColumn("rank", rank).where(F.col("rank") <= top).select("run_id", "id", "o_id", "similarity", "gap", "rank")


def find_duplicates(focus: DataFrame, txns: DataFrame, days: int = 7) -> DataFrame:
    """Other rows of the side with the amount, within days, of a similar vendor."""
    t = focus.select("run_id", "id", F.col("side").alias("o_side"), "date", F.col("amount").alias("o_amount"), "vendor")
    near = near_join(t, _other(txns), ["run_id", "o_side", "o_amount"], [(day_number(F.col("date")), day_number(F.col("o_date")), days)])
    return with_similarity(near.where("id <> o_id"), "vendor", "o_vendor").where("similarity >= 0.85").select("run_id", "id", "o_id", F.abs(F.datediff("date", "o_date")).alias("days"))


def vendor_summary(focus: DataFrame, past: DataFrame, runs: DataFrame, known: DataFrame) -> DataFrame:
    """Per row: number of earlier amounts of similar vendors (.9), their upper median, the last five, and whether the
    vendor is in the master and since when. ``past`` is (side, vendor, date, amount, period) of finished runs,
    ``known`` (run_id, vendor, first_seen, known).

    Names are compared once each; amounts are counted, and only the last five of a period are kept for the last five.
    """
    asked = focus.join(runs.select("run_id", "period"), "run_id").select("side", "vendor", "period").distinct()
    near = similar_pairs(asked.select("vendor"), past.select("vendor"), 0.9).select("vendor", F.col("master").alias("h_vendor"))
    rows = past.withColumnRenamed("vendor", "h_vendor").join(near, "h_vendor").drop("h_vendor").join(asked.select("side", "vendor").distinct(), ["side", "vendor"], "left_semi")
    amounts = stash(counted_amounts(rows), "summary-amounts")
    middle = middles_before(histograms_before(amounts, asked), amounts).select("side", "vendor", "period", "n", (F.col("x2").cast("decimal(20,2)") / 100).cast("decimal(18,2)").alias("median"))
    newest = W.partitionBy("side", "vendor", "at").orderBy(F.desc("date"), F.desc("amount"))
    tops = rows.withColumnRenamed("period", "at").withColumn("k", F.row_number().over(newest)).where("k <= 5").drop("k")
    last = asked.join(tops, ["side", "vendor"]).where("at < period").withColumn("k", F.row_number().over(W.partitionBy("side", "vendor", "period").orderBy(F.desc("date"), F.desc("amount")))).where("k <= 5")
    last = last.groupBy("side", "vendor", "period").agg(F.array_sort(F.collect_list(F.struct("date", "amount"))).alias("last5"))
    out = focus.select("run_id", "id", "side", "vendor").join(runs.select("run_id", "period"), "run_id").join(middle, ["side", "vendor", "period"], "left").join(last, ["side", "vendor", "period"], "left").join(known, ["run_id", "vendor"], "left")
    return out.select("run_id", "id", F.coalesce("n", F.lit(0)).alias("n"), "median", "last5", "first_seen", F.coalesce("known", F.lit(False)).alias("in_master"))


def boundary_matches(focus: DataFrame, external: DataFrame, runs: DataFrame, days: int = 10) -> DataFrame:
    """Out-of-period rows of the other side with the same amount, one to ten days after the period's end."""
    t = focus.join(runs.select("run_id", "period"), "run_id").withColumn("end", F.last_day(month_start(F.col("period"))))
    t = t.select("run_id", "id", "date", "end", F.col("amount").alias("o_amount"), F.when(F.col("side") == "bank", "ledger").otherwise("bank").alias("o_side"))
    hits = t.join(_other(external), ["run_id", "o_side", "o_amount"]).where(F.datediff("o_date", "end").between(1, days))
    return hits.select("run_id", "id", F.datediff("end", "date").alias("days_before_end"), "o_id", F.datediff("o_date", "end").alias("days_after_end"))


def balances(focus: DataFrame, txns: DataFrame, unmatched: DataFrame, openings: DataFrame) -> DataFrame:
    """The account's balance on the date of each row (opening and bank amounts up to that day) and its open rows.

    ``openings`` is (run_id, account_id, opening). The running sum is per account and day, so a window covers
    the days of one account, not its rows.
    """
    daily = txns.where("side = 'bank'").groupBy("run_id", "account_id", "date").agg(F.sum("amount").alias("amount"))
    asked = focus.select("run_id", "account_id", "date", F.lit(0).cast("decimal(28,2)").alias("amount")).distinct()
    days = daily.select("run_id", "account_id", "date", F.col("amount").cast("decimal(28,2)").alias("amount")).unionAll(asked).groupBy("run_id", "account_id", "date").agg(F.sum("amount").alias("amount"))
    upto = F.sum("amount").over(W.partitionBy("run_id", "account_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    running = days.withColumn("upto", upto).select("run_id", "account_id", "date", "upto")
    open_ = unmatched.groupBy("run_id", "account_id").agg(F.count(F.lit(1)).alias("open_rows"))
    out = focus.select("run_id", "id", "account_id", "date").join(running, ["run_id", "account_id", "date"]).join(openings, ["run_id", "account_id"], "left").join(open_, ["run_id", "account_id"], "left")
    return out.select("run_id", "id", (F.col("opening") + F.col("upto")).cast("decimal(28,2)").alias("balance"), F.coalesce("open_rows", F.lit(0)).alias("open_rows"))
