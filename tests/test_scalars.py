import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from reckon.functions import scalars as S


def values(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", make(F.col("t"))).collect())]


def test_dates(spark):
    good = ["05/09/26", "05/09/2026", "05-Sep-2026", "5-Sep-26", "2026-09-05", "05-09-2026", "05-09-26", "05 Sep 2026", "05.09.2026", "5 Sep 26", " 05/09/2026 "]
    assert values(spark, good, S.parse_date) == [dt.date(2026, 9, 5)] * len(good)
    assert values(spark, ["", None, "05/13/2026", "Sept 5", "2026/09/05", "31/02/2026"], S.parse_date) == [None] * 6
    assert values(spark, ["01/01/69", "01/01/68"], S.parse_date) == [dt.date(1969, 1, 1), dt.date(2068, 1, 1)]


def test_money(spark):
    cases = {"1,24,500.00": "124500.00", "₹ 12.5": "12.50", "Rs. 7": "7.00", "Rs7": "7.00", "(3.10)": "-3.10", "5.00 DR": "5.00", "5.00 Cr": "5.00", "": "0.00", " ": "0.00", "-2.345": "-2.35", "1.005": "1.01"}
    assert values(spark, list(cases), S.parse_money) == [Decimal(v) for v in cases.values()]
    assert values(spark, ["abc", "1.2.3", "--1", "n/a"], S.parse_money) == [None] * 4


def test_half_up_goes_towards_plus_infinity(spark):
    df = spark.createDataFrame([(0.125, 0.13), (-0.125, -0.12), (2.675, 2.68), (1.0, 1.0)], "x double, y double")
    assert all(r[0] == r[1] for r in df.select(S.half_up(F.col("x"), 2), "y").collect())


def test_narrations(spark):
    cases = {
        "NEFT DR-HDFC0000123-ACME TRADERS-INV2041": ("NEFT", "ACME TRADERS"), "RTGS-ZEN CO-1": ("RTGS", "ZEN CO"), "UPI/412345678901/SWIGGY/swiggy@ybl": ("UPI", "SWIGGY"),
        "NACH-DR-ZOHO CORP-4471029381": ("NACH", "ZOHO CORP"), "IMPS/P2A/612345098712/OFFICEMART": ("IMPS", "OFFICEMART"), "POS 4521XXXXXXXX9921 MAKEMYTRIP BANGALORE": ("POS", "MAKEMYTRIP"),
        "CLG-000123-RENT": ("CHQ", "RENT"), "bulk neft salary sep": ("NEFT", "Payroll — Bulk salary"), "CHRG SMS": (None, "Bank — charges"), "INT.PD": (None, "Bank — interest"),
        "ATM WDL 1": (None, "ATM cash withdrawal"), "CASH DEP": (None, "Cash deposit"), "Payment to 12345 old/mill road now today": (None, "Payment to old mill"),
    }
    assert values(spark, list(cases), S.channel) == [c for c, _ in cases.values()]
    assert values(spark, list(cases), S.counterparty) == [p for _, p in cases.values()]


def test_names_and_numbers(spark):
    assert values(spark, ["LIC OF INDIA", "acme traders PVT ltd", "BMTC x", "o'neil-smith"], S.display_name) == ["LIC of India", "Acme Traders Pvt Ltd", "BMTC X", "O'Neil-Smith"]
    assert values(spark, ["card 4521XXXXXXXX9921 ok", "ac 123456789012", "short 12345"], S.mask_numbers) == ["card XXXXXXXXXXXX9921 ok", "ac XXXXXXXX9012", "short 12345"]
    assert values(spark, ["Amazon Web Services India", "Solo Pvt Ltd"], S.initials) == ["aws", ""]
    assert values(spark, ["UPI/1/BUNDL/swiggy.pay@ybl", "UPI/1/x", "NEFT-a@b"], S.upi_handle) == ["swiggy pay", None, None]
    money = values(spark, ["124500", "-999.5", "12345678.9", "5"], lambda c: S.inr(c.cast("decimal(18,2)")))
    assert money == ["₹1,24,500.00", "₹999.50", "₹1,23,45,678.90", "₹5.00"]
    assert values(spark, ["12500000", "-250000", "1500", "12"], lambda c: S.compact_money(c.cast("decimal(18,2)"))) == ["₹1.25 Cr", "−₹2.50 L", "₹1.5K", "₹12"]
    assert values(spark, ["hi @Asha Rao and @Ben Lee, @x"], S.mentions) == [["Asha Rao", "Ben Lee"]]
