import re

import pytest
from pyspark.sql import functions as F

from reckon.functions import patterns as P
from reckon.operators import findings as G
from reckon.plans.config import compile_rules

PATTERNS = [
    "chrg", "^chrg$", "(?P<fee>chrg|fee)s?", r"(?P<a_b>[a-z])(?P=a_b)", r"(?P<x>[a-z])(?P=x)1", r"fee\Z", r"[[]", r"[]x]fee", r"[^]x]fee", r"[a&&b]", r"[a-c&]", r"\bfee\b", r"\d{3}", r"é", r"[^\W\d]+", r"a.b", r"(?#note)fee",
    r"(?:fee){2}", r"fee(?!s)", r"(?<=x)fee", r"(fe)?(?(1)e|x)", "(?x) f e e", r"\N{LATIN SMALL LETTER E WITH ACUTE}", r"[\b]", r"(?a:\w)", "~[x~]", "ß", r"\u00e9", r"\x66ee", "a{,2}b", "^", "",
]
TEXTS = ["CHRG", "chrgs", "bank fees", "Fee\n", "fee", "xfee", "]fee", "[fee]", "aa", "aa1", "a&b", "&", "É 123 ١٢٣", "a\nb", "a\rb", "a\u2028b", "feefee", "\x08", "~", "STRASSE ß", "", None, "fe", "ab", "_", "é"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_find_what_python_finds(spark, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = [r.hit for r in df.select("i", P.found_in(F.col("t"), pattern).alias("hit")).orderBy("i").collect()]
    assert got == [re.search(pattern, t or "", re.IGNORECASE) is not None for t in TEXTS]


def test_common_patterns_need_no_python():
    assert all(P.spark_pattern(p) for p in PATTERNS[:14])
    assert not P.compiles("(upi") and P.compiles("(?P<x>upi)")


def test_the_first_rule_that_fits_gives_the_verdict(spark):
    stored = [
        {"id": "R-1", "name": "Charges", "description": "Monthly.", "params": {"pattern": "(?P<x>chrg)", "category": "missing", "maxAmount": 500, "suggestedGl": "4410"}},
        {"id": "R-2", "params": {"pattern": "(chrg", "category": "duplicate"}},
        {"id": "R-3", "enabled": False, "params": {"pattern": "chrg"}},
        {"id": "R-4", "name": "Rest", "params": {"pattern": "(fe)?(?(1)e|chrg)", "category": "timing"}},
    ]
    rules = compile_rules(stored, {}).rules
    assert [r.rule_id for r in rules.classify] == ["R-1", "R-4"]
    rows = [(1, "SMS CHRG", "-118.00"), (2, "SMS CHRG", "-118000.00"), (3, "fee", "7.50"), (4, None, "1.00"), (5, "other", "1.00")]
    df = spark.createDataFrame(rows, "id int, narration string, amount string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.id: r for r in G.classified_by_rule(df, rules).collect()}
    assert [(got[i].class_rule, got[i].class_category, got[i].class_action) for i in range(1, 6)] == [("R-1", "missing", "Post to GL 4410."), ("R-4", "timing", "Book per rule."), ("R-4", "timing", "Book per rule."), (None,) * 3, (None,) * 3]
    assert got[2].class_text == "SMS CHRG (₹1,18,000.00) matches approved rule R-4 “Rest”. " and got[1].class_text.endswith("approved rule R-1 “Charges”. Monthly.")
