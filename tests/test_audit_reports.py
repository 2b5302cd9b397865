import hashlib
import json

from pyspark.sql import functions as F

from reckon.operators import audit as A
from reckon.operators import detectors as D
from reckon.operators import reports as P

SCHEMA = "chain string, seq long, id string, ts string, actor_type string, actor_name string, action string, target string, before string, after string, run_id string, model_version string, ip string"


def entry(chain, seq, action="go", after=None):
    return (chain, seq, f"A-{seq}", "2026-09-05T00:00:00.000Z", "user", 'Åsa "Q" 😀', action, "T\\1\n", None, after, None, "m@1", None)


def canonical(e):
    _, _, id_, ts, kind, name, action, target, before, after, run, model, ip = e
    load = lambda x: None if x is None else json.loads(x)
    body = {"id": id_, "ts": ts, "actor": [kind, name], "action": action, "target": target, "before": load(before), "after": load(after), "runId": run, "modelVersion": model, "ip": ip}
    return json.dumps(body, sort_keys=True, separators=(",", ":"))


def test_chain_equals_python(spark):
    log = [entry(c, i, f"act{i}", A.canonical({"b": 1, "a": [None, "é"]}) if i % 2 else None) for c in "xy" for i in range(1, 8)]
    got = A.build_chain(spark.createDataFrame(log, SCHEMA).withColumnRenamed("chain", "key"), "key")
    by = {(r.key, r.seq): r for r in got.collect()}
    for c in "xy":
        prev = A.GENESIS
        for e in [e for e in log if e[0] == c]:
            assert by[c, e[1]].prev_hash == prev
            prev = hashlib.sha256((prev + canonical(e)).encode()).hexdigest()
            assert by[c, e[1]].hash == prev
    assert {(r.chain, r.ok, r.good) for r in A.verify_chain(got, "key").collect()} == {("x", True, 7), ("y", True, 7)}
    bad = got.withColumn("target", F.when((F.col("key") == "y") & (F.col("seq") == 4), "forged").otherwise(F.col("target")))
    assert {(r.chain, r.ok, r.good) for r in A.verify_chain(bad, "key").collect()} == {("x", True, 7), ("y", False, 3)}
    gone = got.where("not (key = 'x' and seq = 3)")
    assert ("x", False, 2) in {(r.chain, r.ok, r.good) for r in A.verify_chain(gone, "key").collect()}


def test_csv_lines(spark):
    df = spark.createDataFrame([("a", 1.0, None), ('say "x"', 0.95, "b,c"), ("two\nlines", 2.5, "")], "s string, n double, t string")
    assert [r.line for r in P.csv_line(df).collect()] == ["a,1,", '"say ""x""",0.95,"b,c"', '"two\nlines",2.5,']


def test_risk_and_contributions(spark):
    df = spark.createDataFrame([([0.6, 0.5, 1.4, -1.0],), ([0.5, 0.5],), ([],)], "s array<double>")
    rows = df.select(D.risk(F.col("s")), D.contributions(F.col("s"))).collect()
    assert [r[0] for r in rows] == [1.0, 0.75, 0.0]
    assert rows[1][1] == [0.5, 0.25] and abs(sum(rows[0][1]) - 1.0) < 1e-12
    levels = spark.createDataFrame([(x,) for x in (0.39, 0.4, 0.7, 0.85)], "x double").select(D.risk_level(F.col("x"))).collect()
    assert [r[0] for r in levels] == ["low", "medium", "high", "critical"]
