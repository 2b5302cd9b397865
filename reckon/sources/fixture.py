"""Bank and ledger transactions derived from the order tables, many months (runs) at once.

The text below is plain SQL that Spark and DuckDB read alike, so that both engines derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Invented names of which no two are similar (at most .54).
VENDORS = "kofi zumba hexly trivo quench blast qyjobu xoheve bewuko vixisi gawaxe jijepa zapiry gusugu nykysy vacolo bodyxa muryqi".split()


def _vendor(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(VENDORS)} = {i} THEN '{v}'" for i, v in enumerate(VENDORS)) + " END"


#: Ledger rows: one for each order.
LEDGER = f"""
SELECT 'L-' || CAST(o_orderkey AS VARCHAR(20)) AS id, 'run_' || substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) AS run_id,
       'ledger' AS side, CAST(o_orderdate AS DATE) AS date,
       CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE -1 END * CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount,
       {_vendor("o_custkey")} AS vendor, {_vendor("o_custkey")} || ' supplies' AS narration,
       CASE WHEN o_orderkey % 3 = 0 THEN 'PV-' ELSE 'INV-' END || CAST(o_orderkey AS VARCHAR(20)) AS reference,
       CASE WHEN o_custkey % 2 = 0 THEN 'acc0' ELSE 'acc1' END AS account_id, CAST(NULL AS VARCHAR(8)) AS channel,
       CAST(o_orderkey * 10 AS BIGINT) AS ord, o_orderkey AS orderkey
FROM orders"""

#: Bank rows of the same orders: some missing, some late, some with a changed amount, some twice.
BANK = f"""
SELECT 'B-' || CAST(o_orderkey AS VARCHAR(20)) || CASE WHEN copy = 1 THEN '-2' ELSE '' END AS id,
       'run_' || substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) AS run_id, 'bank' AS side,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT) AS date,
       CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE -1 END * CASE WHEN o_orderkey % 50 = 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.98 AS DECIMAL(3,2)) AS DECIMAL(18,2)) WHEN o_orderkey % 9 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) + CAST(0.50 AS DECIMAL(3,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount,
       {_vendor("o_custkey")} AS vendor,
       CASE o_orderkey % 7
         WHEN 0 THEN 'NEFT CR-HDFC0000123-' || upper({_vendor("o_custkey")}) || '-INV' || CAST(o_orderkey AS VARCHAR(20))
         WHEN 1 THEN 'RTGS-' || upper({_vendor("o_custkey")}) || '-PAYMENT'
         WHEN 2 THEN 'UPI/412345678901/' || upper({_vendor("o_custkey")}) || '/' || {_vendor("o_custkey")} || '@ybl'
         WHEN 3 THEN 'NACH-DR-' || upper({_vendor("o_custkey")}) || '-4471029381'
         WHEN 4 THEN 'IMPS/P2A/612345098712/' || upper({_vendor("o_custkey")})
         WHEN 5 THEN 'POS 4521XXXXXXXX9921 ' || upper({_vendor("o_custkey")}) || ' MUMBAI'
         ELSE 'CLG-000123-' || upper({_vendor("o_custkey")}) END AS narration,
       CAST(NULL AS VARCHAR(20)) AS reference, CASE WHEN o_custkey % 2 = 0 THEN 'acc0' ELSE 'acc1' END AS account_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'NEFT' WHEN 1 THEN 'RTGS' WHEN 2 THEN 'UPI' WHEN 3 THEN 'NACH' WHEN 4 THEN 'IMPS' WHEN 5 THEN 'POS' ELSE 'CHQ' END AS channel,
       CAST(o_orderkey * 10 + copy AS BIGINT) AS ord, o_orderkey AS orderkey
FROM (SELECT *, 0 AS copy FROM orders UNION ALL SELECT *, 1 AS copy FROM orders WHERE o_orderkey % 97 = 0) o
WHERE o_orderkey % 20 <> 0"""

_TXNS = f"{LEDGER} UNION ALL {BANK}"

#: All rows, with ``external`` for those dated outside the month of their run.
TXNS = f"""
SELECT *, substr(CAST(date AS VARCHAR(10)), 1, 7) <> substr(run_id, 5, 7) AS external FROM ({_TXNS}) t"""

#: Runs: one for each month of orders.
RUNS = """
SELECT DISTINCT 'run_' || substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) AS run_id,
       substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 7) AS period, 'awaiting_review' AS status,
       CAST(100000 AS DECIMAL(18,2)) AS approval_limit, CAST(300000 AS DECIMAL(18,2)) AS high_value, false AS same_account
FROM orders"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of all runs, with ``external``."""
    return spark.sql(TXNS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions dated within the month of their run."""
    return txns(spark, sf_dir).where(~F.col("external"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
