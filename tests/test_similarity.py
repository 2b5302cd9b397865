import random

import pytest
from pyspark.sql import functions as F

from reckon.functions import similarity as S


def slow_jaro_winkler(a, b):
    """The definition, a character at a time."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, pairs = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            pairs.append(c)
    if not pairs:
        return 0.0
    other = [b[j] for j in sorted(used)]
    swaps = sum(x != y for x, y in zip(pairs, other))
    m = len(pairs)
    jaro = (m / len(a) + m / len(b) + (m - swaps / 2) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def test_jaro_winkler_equals_its_definition():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcde", k=rng.randint(0, 12))) for _ in range(1500)]
    a, b = words[:750], words[750:]
    assert S.jaro_winkler(a, b).tolist() == [slow_jaro_winkler(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("AMZN MKTP US*2K4", "Amazon", 0.91), ("AWS INDIA", "Amazon Web Services India", 0.53), ("ACME TRDRS", "ACME Traders Pvt Ltd", 0.97), ("RZP SETTLEMENT", "Razorpay Software", 0.79), ("BUNDL TECHNOLOGIES", "Swiggy", 0.4), ("", "", 0.0), ("Amazon", "", 0.0)],
)
def test_known_similarities(a, b, want):
    assert S.vendor_similarity([a], [b])[0] == S.vendor_similarity([b], [a])[0] == want


def test_tokens_agree_in_python_and_spark(spark):
    names = ["AMZN MKTP US*2K4", "Amazon Web Services India Pvt Ltd", "A-1 the Co", "É shop 24x7", "", None, "NEFT  pay  x yy"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(S.token_column(F.col("n"))).collect()
    assert [list(r[0]) for r in rows] == [S.tokens(n) for n in names]


def test_distinct_pairs_join_back(spark):
    df = spark.createDataFrame([("kofi", "kofi"), ("kofi", "zumba"), (None, "x"), ("the", "the"), ("kofi", "zumba")], "a string, b string")
    got = sorted((r.a or "", r.b, r.similarity) for r in S.with_similarity(df, "a", "b").collect())
    one = S.vendor_similarity(["kofi"], ["zumba"])[0]
    assert got == [("", "x", 0.0), ("kofi", "kofi", 1.0), ("kofi", "zumba", one), ("kofi", "zumba", one), ("the", "the", 0.0)]
