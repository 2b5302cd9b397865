"""Results that must come out exactly."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reckon.functions import scalars
from reckon.functions import similarity as S
from reckon.operators import detectors as D
from reckon.operators import matching as M
from reckon.operators.numbering import numbered

# Two names and their similarity.
NAMES = [
    ("AMZN MKTP US*2K4", "Amazon", 0.91),
    ("AWS INDIA", "Amazon Web Services India", 0.53),
    ("ACME TRDRS", "ACME Traders Pvt Ltd", 0.97),
    ("RZP SETTLEMENT", "Razorpay Software", 0.79),
    ("BUNDL TECHNOLOGIES", "Swiggy", 0.4),
    ("", "", 0.0),
    ("", "Amazon", 0.0),
    ("Amazon", "", 0.0),
    ("Amazon", "Amazon", 1.0),
    ("ACME Traders", "ACME Traders", 1.0),
    ("12345", "67890", 0.0),
    ("NEFT 998877 ACME", "ACME", 1.0),
    ("AMZN WEB SVCS", "Amazon Web Services", 0.97),
    ("AMAZON WEB SERVICES", "Amazon Web Services India Pvt Ltd", 1.0),
    ("Infosys Ltd", "Infosys Limited", 1.0),
    ("TATA CONSULTANCY", "Tata Consultancy Services", 1.0),
    ("TCS", "Tata Consultancy Services", 0.76),
    ("HDFC BANK", "HDFC Bank Ltd", 1.0),
    ("ZOMATO MEDIA", "Zomato Ltd", 0.97),
    ("SWIGGY", "Bundl Technologies", 0.4),
    ("UPI/PAYTM/9876", "Paytm", 1.0),
    ("FLIPKART INTERNET", "Flipkart Internet Pvt Ltd", 1.0),
    ("FLPKRT", "Flipkart", 0.93),
    ("RELIANCE JIO", "Reliance Jio Infocomm", 0.97),
    ("BHARTI AIRTEL", "Airtel", 0.97),
    ("MSFT AZURE", "Microsoft Azure", 0.97),
    ("GOOGLE CLOUD", "Google India Pvt Ltd", 0.97),
    ("OLA CABS", "ANI Technologies", 0.59),
    ("Salary June", "Salary July", 0.97),
    ("a b c", "x y z", 0.0),
    ("The Co Ltd", "Pvt Inc", 0.0),
    ("Acme-Traders/Mumbai", "ACME TRADERS MUMBAI", 1.0),
    ("WIPRO", "Wipro Enterprises", 0.97),
    ("MARTHA", "MARHTA", 0.96),
    ("DWAYNE", "DUANE", 0.84),
    ("DIXON", "DICKSONX", 0.81),
    ("Café Coffee Day", "Cafe Coffee Day", 0.97),
    ("ACME2 TRADERS", "ACME TRADERS", 0.97),
    ("Rent Oct 2026", "Office Rent", 0.97),
    ("PAYU PAYMENTS", "PayU Payments Pvt Ltd", 1.0),
    ("CRED", "Dreamplug Technologies", 0.51),
    ("  ACME   TRADERS  ", "acme traders", 1.0),
    ("Ab", "Ab", 1.0),
    ("MKTP", "Amazon", 0.0),
]

# Two strings and their Jaro-Winkler similarity.
STRINGS = [
    ("", "", 1.0),
    ("", "a", 0.0),
    ("a", "", 0.0),
    ("a", "a", 1.0),
    ("a", "b", 0.0),
    ("ab", "ba", 0.0),
    ("martha", "marhta", 0.9611111111111111),
    ("dwayne", "duane", 0.8400000000000001),
    ("dixon", "dicksonx", 0.8133333333333332),
    ("crate", "trace", 0.7333333333333334),
    ("amzn", "amazon", 0.9111111111111111),
    ("acme traders", "acme trdrs", 0.9666666666666667),
    ("abc", "abcd", 0.9416666666666667),
    ("abcd", "abc", 0.9416666666666667),
    ("jellyfish", "smellyfish", 0.8962962962962964),
    ("prefixmatch", "prefixmatchy", 0.9833333333333333),
    ("aws", "amazon web", 0.53),
    ("12345", "12354", 0.9533333333333333),
    ("razorpay software", "rzp settlement", 0.6735294117647058),
    ("bundl technologies", "swiggy", 0.0),
]

# A name and its words.
WORDS = [
    ("AMZN MKTP US*2K4", ["amzn"]),
    ("Amazon Web Services India Pvt Ltd", ["amazon", "web"]),
    ("", []),
    ("   ", []),
    ("NEFT/RTGS/IMPS UPI", []),
    ("ACME TRDRS 12345", ["acme", "trdrs"]),
    ("ab1 cd ef2", ["cd"]),
    ("Café Coffee Day", ["caf", "coffee", "day"]),
    ("X Y Z", []),
    ("The ACME and Co", ["acme"]),
    ("PAYMENT TO ACME SVC", ["to", "acme"]),
    ("ACME-Traders/Mumbai_Branch", ["acme", "traders", "mumbai", "branch"]),
    ("HDFC0001234 SALARY", ["salary"]),
    ("a\tb\ncde  fgh", ["cde", "fgh"]),
]

# A number, places, and the number rounded to them.
ROUNDED = [
    (0.125, 2, 0.13),
    (2.5, 0, 3.0),
    (-2.5, 0, -2.0),
    (-0.5, 0, 0.0),
    (1.005, 2, 1.0),
    (0.0005, 3, 0.001),
    (0.4445, 3, 0.445),
    (0.9549999, 2, 0.95),
    (0.955, 2, 0.96),
    (12.345, 2, 12.35),
    (0.2675, 3, 0.268),
]

# Scores of signals and their risk.
RISKS = [
    ([], 0.0),
    ([0.0], 0.0),
    ([1.0], 1.0),
    ([0.5], 0.5),
    ([0.5, 0.5], 0.75),
    ([0.3, 0.4, 0.2], 0.664),
    ([0.6, 0.45, 0.35, 0.25], 0.8927499999999999),
    ([1.5, -0.2, 0.3], 1.0),
    ([0.9, 0.9, 0.9], 0.999),
    ([0.18, 0.234, 0.5, 0.07, 0.11], 0.740052538),
]

# A risk and its level.
LEVELS = [
    (0.0, "low"),
    (0.39, "low"),
    (0.3999999, "low"),
    (0.4, "medium"),
    (0.69, "medium"),
    (0.7, "high"),
    (0.84, "high"),
    (0.85, "critical"),
    (0.849999, "high"),
    (1.0, "critical"),
    (1.2, "critical"),
    (-0.1, "low"),
]

# Bank rows, ledger rows, evidence, the parts of the score and the score.
SCORES = [
    ([("-1000.00", "2026-09-10", "ACME TRDRS")], [("-1000.00", "2026-09-10", "ACME Traders Pvt Ltd")], True, (0.45, 0.15, 0.243, 0.15), 0.993),
    ([("-1000.00", "2026-09-10", "ACME TRDRS")], [("-999.50", "2026-09-12", "ACME Traders Pvt Ltd")], None, (0.439, 0.126, 0.243, 0.09), 0.898),
    ([("-5000.00", "2026-09-01", "AMZN MKTP US*2K4")], [("-5001.00", "2026-09-04", "Amazon")], False, (0.428, 0.114, 0.228, 0.03), 0.8),
    ([("250000.00", "2026-09-15", "RZP SETTLEMENT")], [("100000.00", "2026-09-14", "Razorpay Software"), ("100000.00", "2026-09-15", "Razorpay Software"), ("50000.00", "2026-09-15", "Razorpay Software")], None, (0.45, 0.138, 0.198, 0.09), 0.876),
    ([("-60000.00", "2026-09-20", "BUNDL TECHNOLOGIES"), ("-40000.00", "2026-09-21", "BUNDL TECHNOLOGIES")], [("-100000.00", "2026-09-18", "Swiggy")], False, (0.45, 0.126, 0.1, 0.03), 0.706),
    ([("-100.00", "2026-09-01", "X")], [("-130.00", "2026-09-30", "Y")], False, (0.0, 0.0, 0.0, 0.03), 0.03),
    ([("-1000.00", "2026-09-01", "AWS INDIA")], [("-1007.37", "2026-09-08", "Amazon Web Services India")], True, (0.284, 0.066, 0.133, 0.15), 0.633),
    ([("10.005", "2026-09-01", "Acme")], [("10.00", "2026-09-01", "Acme")], True, (0.45, 0.15, 0.25, 0.15), 1.0),
    ([("10.125", "2026-09-01", "Acme")], [("10.00", "2026-09-01", "Acme")], True, (0.447, 0.15, 0.25, 0.15), 0.997),
    ([("100.025", "2026-09-01", "Acme")], [("100.00", "2026-09-01", "Acme")], True, (0.449, 0.15, 0.25, 0.15), 0.999),
    ([("-501.005", "2026-09-02", "Acme")], [("-500.00", "2026-09-01", "Acme")], None, (0.427, 0.138, 0.25, 0.09), 0.905),
    ([("-2000.00", "2026-03-08", "MSFT AZURE")], [("-2000.00", "2026-03-10", "Microsoft Azure")], None, (0.45, 0.126, 0.243, 0.09), 0.909),
]


def test_names():
    assert S.vendor_similarity([a for a, _, _ in NAMES], [b for _, b, _ in NAMES]).tolist() == [s for _, _, s in NAMES]


def test_strings():
    assert S.jaro_winkler([a for a, _, _ in STRINGS], [b for _, b, _ in STRINGS]).tolist() == [s for _, _, s in STRINGS]


def test_words(spark):
    assert [S.tokens(n) for n, _ in WORDS] == [w for _, w in WORDS]
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(WORDS)], "i int, n string").orderBy("i").select(S.token_column(F.col("n"))).collect()
    assert [list(r[0]) for r in rows] == [w for _, w in WORDS]


def test_rounding(spark):
    row = spark.range(1).select(*[scalars.half_up(F.lit(x).cast("double"), dp).alias(f"c{i}") for i, (x, dp, _) in enumerate(ROUNDED)]).first()
    assert list(row) == [r for _, _, r in ROUNDED]


def test_risks_and_levels(spark):
    row = spark.range(1).select(*[D.risk(F.array(*[F.lit(float(s)) for s in scores]) if scores else F.array().cast("array<double>")) for scores, _ in RISKS]).first()
    assert list(row) == pytest.approx([r for _, r in RISKS], abs=1e-12)
    assert list(spark.range(1).select(*[D.risk_level(F.lit(x)) for x, _ in LEVELS]).first()) == [k for _, k in LEVELS]


def test_scores(spark):
    for bank, ledger, named, parts, score in SCORES:
        first = lambda rows, p: {f"{p}_date": dt.date.fromisoformat(rows[0][1]), f"{p}_vendor": rows[0][2], f"{p}_amount": sum(Decimal(a) for a, _, _ in rows)}
        row = first(bank, "b") | first(ledger, "l") | {"evidence": named}
        df = spark.createDataFrame([tuple(row.values())], "b_date date, b_vendor string, b_amount decimal(18,4), l_date date, l_vendor string, l_amount decimal(18,4), evidence boolean")
        got = M.scored(df).first()
        assert (got.amount_part, got.date_part, got.vendor_part, got.reference_part) == parts and got.score == score


def test_numbers_of_a_group_over_many_partitions(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 5 else "x", (i * 7919) % 3001, i) for i in range(3000)] + [("one", 1, 5), ("one", 1, 5)]
    df = spark.createDataFrame(rows, "g string, o int, id int")
    got = numbered(df, "g", ["o", "id"], "n").collect()
    for g in (None, "hot", "one"):
        mine = sorted((r.n, r.o, r.id) for r in got if r.g == g)
        assert [n for n, _, _ in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert len(got) == 3002 and numbered(df.limit(0), "g", ["o"], "n").count() == 0
