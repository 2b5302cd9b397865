"""Audit trail: building and verifying a chain of SHA-256 hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64
ENTRY = ("id", "ts", "actor_type", "actor_name", "action", "target", "before", "after", "run_id", "model_version", "ip")


def _ascii(text: Column) -> Column:
    """A JSON string in ASCII: quotes and controls escaped by Spark's writer, anything else beyond ASCII as \\uXXXX."""
    body = F.to_json(F.struct(text.alias("x")))
    plain = F.substring(body, 6, 1 << 30)
    plain = F.substring(plain, F.lit(1), F.length(plain) - 1)
    chars = F.split(plain, "")

    def one(c: Column) -> Column:
        code = F.ascii(c)
        unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        high = unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10))
        low = unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF))
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(F.concat(high, low))

    escaped = F.when(plain.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(chars, one), "")).otherwise(plain)
    return F.when(text.isNull(), "null").otherwise(escaped)


def payload() -> Column:
    """The canonical JSON of an entry: keys sorted, compact, ASCII. ``before`` and ``after`` hold canonical JSON or null."""
    c = lambda name: _ascii(F.col(name).cast("string"))
    raw = lambda name: F.coalesce(F.col(name), F.lit("null"))
    return F.concat(
        F.lit('{"action":'), c("action"), F.lit(',"actor":['), c("actor_type"), F.lit(","), c("actor_name"), F.lit('],"after":'), raw("after"), F.lit(',"before":'), raw("before"),
        F.lit(',"id":'), c("id"), F.lit(',"ip":'), c("ip"), F.lit(',"modelVersion":'), c("model_version"), F.lit(',"runId":'), c("run_id"), F.lit(',"target":'), c("target"), F.lit(',"ts":'), c("ts"), F.lit("}"),
    )


def canonical(value: object) -> str:
    """Canonical JSON of a before or after value."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by chain and seq to their hashes; only the last hash is carried from one to the next."""
    now, prev = object(), GENESIS
    for batch in batches:
        before, hashes = [], []
        for chain, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if chain != now:
                now, prev = chain, GENESIS
            before.append(prev)
            prev = hashlib.sha256((prev + text).encode()).hexdigest()
            hashes.append(prev)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=["chain", "seq", "prev_hash", "hash"])


def build_chain(log: DataFrame, chain: str) -> DataFrame:
    """Add prev_hash and hash to the entries of each chain, in the order of seq. A chain is serial by nature: its payloads
    stream through one task, sorted by Spark, whatever its length."""
    rows = log.select(F.col(chain).cast("string").alias("chain"), F.col("seq").cast("long").alias("seq"), payload().alias("payload"))
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "chain").sortWithinPartitions("chain", "seq")
    linked = ordered.mapInArrow(_link, "chain string, seq long, prev_hash string, hash string")
    return log.withColumn("chain", F.col(chain).cast("string")).join(linked, ["chain", "seq"]).drop("chain")


def verify_chain(log: DataFrame, chain: str) -> DataFrame:
    """Per chain: ok, and the number of good entries before the first break.

    Entries are numbered in their chain and joined to their predecessor by number, so a long chain is checked
    in parallel: an entry is good if its own hash is right and the one before it carries its prev_hash.
    """
    rows = log.withColumn("payload", payload()).select(F.col(chain).cast("string").alias("chain"), "seq", "prev_hash", "hash", "payload")
    own = F.col("hash") == F.sha2(F.concat("prev_hash", "payload"), 256)
    after = rows.select("chain", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("expected"))
    first = rows.groupBy("chain").agg(F.min("seq").alias("start"))
    joined = rows.join(after, ["chain", "seq"], "left").join(first, "chain")
    linked = F.col("prev_hash") == F.when(F.col("seq") == F.col("start"), GENESIS).otherwise(F.col("expected"))
    judged = joined.withColumn("good", F.coalesce(own & linked, F.lit(False)))
    breaks = judged.groupBy("chain").agg(F.min(F.when(~F.col("good"), F.col("seq"))).alias("bad"))
    before = F.count(F.when(F.col("bad").isNull() | (F.col("seq") < F.col("bad")), 1))
    return judged.join(breaks, "chain").groupBy("chain").agg(F.first(F.col("bad").isNull()).alias("ok"), before.alias("good"))
