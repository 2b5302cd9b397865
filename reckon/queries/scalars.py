"""Queries of the scalar functions, over rows derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from reckon.functions import scalars as S
from reckon.functions.similarity import jaro_winkler_udf, skeleton_column, token_column, vendor_similarity_udf
from reckon.queries import plain
from reckon.sources import fixture
from reckon.sources.fixture import BANK, TXNS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _orders(spark, d):
    return fixture.table(spark, d, "orders")


def _bank(spark, d):
    return fixture.txns(spark, d).where("side = 'bank'")


@query("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders")
def sc1_parse_date(spark, d):
    formats = ["dd/MM/yy", "dd/MM/yyyy", "dd-MMM-yyyy", "dd-MMM-yy", "yyyy-MM-dd", "dd-MM-yyyy", "dd-MM-yy", "dd MMM yyyy", "dd.MM.yyyy", "dd MMM yy"]
    text = F.lit(None).cast("string")
    for i, f in enumerate(formats):
        text = F.when(F.col("o_orderkey") % 10 == i, F.date_format("o_orderdate", f)).otherwise(text)
    return _orders(spark, d).select(F.col("o_orderkey").alias("id"), S.parse_date(F.concat(F.lit(" "), text)).alias("date"))


_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


@query(f"""SELECT o_orderkey AS id, CAST(CASE o_orderkey % 6 WHEN 1 THEN -{_PRICE} WHEN 5 THEN 0 ELSE {_PRICE} END AS DECIMAL(18,2)) AS amount FROM orders""")
def sc2_parse_money(spark, d):
    price = F.col("o_totalprice").cast(S.MONEY)
    k = F.col("o_orderkey") % 6
    plain = price.cast("string")
    text = (
        F.when(k == 0, S.inr(price)).when(k == 1, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 2, F.concat(F.lit("Rs. "), plain, F.lit(" DR")))
        .when(k == 3, F.concat(plain, F.lit(" cr"))).when(k == 4, F.concat(F.lit(" Rs"), F.format_number(price, 2), F.lit(" "))).otherwise("")
    )
    return _orders(spark, d).select(F.col("o_orderkey").alias("id"), S.parse_money(text).alias("amount"))


@query(f"""SELECT o_orderkey AS id,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN {_PRICE} ELSE -{_PRICE} END AS DECIMAL(18,2)) AS statement,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN -{_PRICE} ELSE {_PRICE} END AS DECIMAL(18,2)) AS day_book,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN (CASE WHEN o_orderkey % 3 = 0 THEN {_PRICE} ELSE -{_PRICE} END) ELSE -{_PRICE} END AS DECIMAL(18,2)) AS own
FROM orders""")
def sc3_signed_amount(spark, d):
    plain = F.col("o_totalprice").cast(S.MONEY).cast("string")
    credit = F.when(F.col("o_orderkey") % 3 == 0, plain).otherwise("")
    debit = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(plain)
    own = F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(plain)
    return _orders(spark, d).select(
        F.col("o_orderkey").alias("id"), S.signed_amount(None, debit, credit, False).alias("statement"), S.signed_amount(None, debit, credit, True).alias("day_book"),
        S.signed_amount(own, debit, credit, False, True).alias("own"),
    )


@query(f"""SELECT run_id, side, count(*) FILTER (WHERE NOT external) AS inside, count(*) FILTER (WHERE external) AS outside,
  CAST(coalesce(sum(amount) FILTER (WHERE external), 0) AS DECIMAL(28,2)) AS outside_total FROM ({TXNS}) GROUP BY run_id, side""")
def sc7_period_split(spark, d):
    rows = fixture.txns(spark, d).drop("external").join(F.broadcast(fixture.runs(spark, d).select("run_id", "period")), "run_id")
    inside = S.in_period(F.col("date"), F.col("period"))
    return rows.groupBy("run_id", "side").agg(
        F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(~inside, 1)).alias("outside"),
        F.coalesce(F.sum(F.when(~inside, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").alias("outside_total"),
    )


@query(f"SELECT id, channel FROM ({BANK})")
def sc8_channel(spark, d):
    return _bank(spark, d).select("id", S.channel(F.col("narration")).alias("channel"))


@query(f"SELECT id, CASE WHEN orderkey % 7 = 0 OR orderkey % 7 = 2 THEN upper(vendor) ELSE upper(vendor) END AS party FROM ({BANK})")
def sc9_counterparty(spark, d):
    return _bank(spark, d).select("id", S.counterparty(F.col("narration")).alias("party"))


@query(f"""SELECT id, CASE WHEN regexp_matches(vendor, '[aeiou]') THEN upper(substr(vendor, 1, 1)) || substr(vendor, 2) ELSE upper(vendor) END || ' of ABC Pvt ' || CASE WHEN orderkey % 2 = 0 THEN 'The-End' ELSE 'XYZT' END AS name FROM ({BANK})""")
def sc10_display_name(spark, d):
    raw = F.concat(F.upper("vendor"), F.lit(" OF ABC  PVT "), F.when(F.col("orderkey") % 2 == 0, "THE-END").otherwise("XYZT"))
    return _bank(spark, d).select("id", S.display_name(raw).alias("name"))


@query(f"SELECT id, CASE WHEN channel = 'UPI' THEN vendor END AS handle FROM ({BANK})")
def sc11_upi_handle(spark, d):
    return _bank(spark, d).select("id", S.upi_handle(F.col("narration")).alias("handle"))


@query(f"""SELECT id, CASE orderkey % 7 WHEN 2 THEN replace(narration, '412345678901', 'XXXXXXXX8901')
  WHEN 4 THEN replace(narration, '612345098712', 'XXXXXXXX8712') WHEN 5 THEN replace(narration, '4521XXXXXXXX9921', 'XXXXXXXXXXXX9921') ELSE narration END AS masked FROM ({BANK})""")
def sc12_mask_numbers(spark, d):
    return _bank(spark, d).select("id", S.mask_numbers(F.col("narration")).alias("masked"))


@query(f"SELECT id, regexp_replace(upper(narration), '[^A-Z0-9]', '', 'g') AS reference FROM ({BANK})")
def sc13_normal_reference(spark, d):
    return _bank(spark, d).select("id", S.normal_reference(F.col("narration")).alias("reference"))


@query(f"SELECT id, CASE WHEN orderkey % 7 = 5 THEN vendor || '|mumbai' WHEN orderkey % 7 = 1 THEN vendor WHEN orderkey % 7 = 2 THEN vendor || '|' || vendor || '|ybl' WHEN orderkey % 7 = 6 THEN 'clg|' || vendor ELSE vendor END AS words FROM ({BANK})")
def sc14_vendor_tokens(spark, d):
    return _bank(spark, d).select("id", F.array_join(token_column(F.col("narration")), "|").alias("words"))


@query(f"""SELECT id, substr(vendor, 1, 1) || regexp_replace(substr(vendor, 2), '[aeiou]', '', 'g') AS skeleton, substr(vendor, 1, 1) || 'ws' AS initials FROM ({BANK})""")
def sc15_skeleton_initials(spark, d):
    return _bank(spark, d).select("id", skeleton_column(F.col("vendor")).alias("skeleton"), S.initials(F.concat("vendor", F.lit(" Web Services India Pvt Ltd"))).alias("initials"))


@query(f"SELECT DISTINCT a.vendor AS a, a.vendor AS b, CAST(1 AS DOUBLE) AS same, CAST(1 AS DOUBLE) AS similar FROM ({BANK}) a")
def sc16_sc17_similarity(spark, d):
    names = _bank(spark, d).select(F.col("vendor").alias("a")).distinct()
    both = names.withColumn("b", F.col("a"))
    return both.select("a", "b", jaro_winkler_udf("a", F.concat("b")).alias("same"), vendor_similarity_udf(F.concat(F.upper("a"), F.lit(" PVT LTD")), "b").alias("similar"))


@query(f"SELECT DISTINCT v.vendor AS a, b, jw AS same, sim AS similar FROM ({BANK}) v JOIN {plain.table([(a, c) for a in fixture.VENDORS for b in fixture.VENDORS for c in plain.changed(b)][::3], 'nm(a, b, jw, sim)')} ON nm.a = v.vendor")
def sc16_sc17_unequal_names(spark, d):
    """Every vendor of the rows against misspellings of all vendors, every third pair."""
    wrong = [(a, c) for a in fixture.VENDORS for b in fixture.VENDORS for c in plain.changed(b)][::3]
    names = spark.createDataFrame(wrong, "a string, b string").join(_bank(spark, d).select(F.col("vendor").alias("a")).distinct(), "a").distinct()
    return names.select("a", "b", jaro_winkler_udf("a", "b").alias("same"), vendor_similarity_udf(F.concat(F.upper("a"), F.lit(" PVT LTD")), "b").alias("similar"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, floor((l_discount - l_tax) * l_extendedprice * 100.0 + 0.5) / 100.0 AS rounded FROM lineitem")
def sc18_half_up(spark, d):
    rows = fixture.table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), S.half_up((F.col("l_discount") - F.col("l_tax")) * F.col("l_extendedprice"), 2).alias("rounded"))


@query(r"""SELECT o_orderkey AS id, '₹' || regexp_replace(CASE WHEN p >= 100000 THEN CAST(p // 100000 AS VARCHAR) || ',' || lpad(CAST((p // 1000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0')
   WHEN p >= 1000 THEN CAST(p // 1000 AS VARCHAR) || ',' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0') ELSE CAST(p AS VARCHAR) END, '$', '') || '.' || lpad(CAST(CAST((a - p) * 100 AS INTEGER) AS VARCHAR), 2, '0') AS text
   FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT) AS p FROM orders)""")
def sc19_money_text(spark, d):
    return _orders(spark, d).select(F.col("o_orderkey").alias("id"), S.inr(-F.col("o_totalprice").cast(S.MONEY)).alias("text"))


@query("SELECT event_id, regexp_extract_all('@Asha Rao saw ' || event_type || ', @Ben Lee and @x', '@([A-Z][a-z]+ [A-Z][a-z]+)', 1)[2] AS second FROM events")
def sc20_mentions(spark, d):
    rows = fixture.table(spark, d, "events")
    return rows.select("event_id", F.get(S.mentions(F.concat(F.lit("@Asha Rao saw "), "event_type", F.lit(", @Ben Lee and @x"))), F.lit(1)).alias("second"))
