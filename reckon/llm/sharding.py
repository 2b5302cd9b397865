"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Documents of equal text form a group. A group that alone outweighs a sixteenth of a shard is split into
salted pieces. Pieces that are large against a packing block go first, in one small task; the number of them
is bounded by the number of blocks. All others are dealt into blocks by hash, and each block is packed on
its own against its share of what every shard can still take: largest first, each piece to the shard where
the dot product of its sizes with the residual capacity is highest. Only sizes travel, never texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reckon.durable import stash
from reckon.llm.mixing import word_count

SHARDS = 24
DIMS = ("bytes", "tokens", "rows")
#: Weight of each dimension in the dot product; the sizes in bytes are what must come out near equal.
EMPHASIS = np.array([1.0, 0.05, 0.003])
WHOLE = 16
WIDE = 8
GROUPS_PER_BLOCK = 4000
MAX_BLOCKS = 4096
SLOT_ROWS = 50_000


def pack(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each row of ``sizes`` [n, 3], given the residual capacity ``room`` [shards, 3], which is used up."""
    unit = np.maximum(np.abs(room).sum(axis=0), 1e-9)
    items = sizes / unit
    left = room / unit * EMPHASIS
    spent = items * EMPHASIS
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-items[:, 0], kind="stable"):
        s = int(np.argmax(left @ items[i]))
        out[i] = s
        left[s] -= spent[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``tokens``, ``law`` (bytes), ``shard``, ``slot``, ``grown_shard``.

    Size is the UTF-8 length plus 8. Slots count from 0 in each shard without a gap. Null texts weigh 8 and
    group with empty ones; repeated rows and null ids get slots of their own; an empty table gives no rows;
    other columns are not used. The same rows give the same result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), word_count(text).alias("tokens"),
        F.xxhash64(text).alias("group"),
    )
    rows = stash(rows, "shard-rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = rows.groupBy("group").agg(*sums)
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS], F.count(F.lit(1)).alias("groups")).first()
    whole = np.array([float(total[d] or 0) for d in DIMS])
    blocks = int(min(MAX_BLOCKS, max(1, -(-total["groups"] // GROUPS_PER_BLOCK))))
    share = F.greatest(*[F.col(d) / F.lit(max(w, 1.0)) for d, w in zip(DIMS, whole)])
    # at most WHOLE * shards groups can exceed this share in each of three dimensions
    heavy = groups.withColumn("share", share).where(F.col("share") > 1 / (WHOLE * shards)).select("group", F.ceil(F.col("share") * WHOLE * shards).alias("pieces"))
    salt = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col, F.lit("salt")), F.col("pieces"))).cast("int")
    salted = rows.join(F.broadcast(heavy), "group", "left").withColumn("salt", salt).drop("pieces")
    pieces = stash(salted.groupBy("group", "salt").agg(*sums).withColumn("wide", share > 1 / (WIDE * shards * blocks)), "shard-pieces")
    schema = "group long, salt int, shard int"

    def placed(frame: pd.DataFrame, room: np.ndarray) -> pd.DataFrame:
        frame = frame.sort_values(["group", "salt"], kind="stable")
        return frame[["group", "salt"]].assign(shard=pack(frame[list(DIMS)].to_numpy(float), room).astype(np.int32))

    full = np.tile(whole / shards, (shards, 1))
    wide = pieces.where("wide").groupBy("wide").applyInPandas(lambda frame: placed(frame, full.copy()), schema)
    wide = stash(wide, "shard-wide")
    used = np.zeros((shards, 3))
    for r in pieces.join(wide, ["group", "salt"]).groupBy("shard").agg(*[F.sum(d).alias(d) for d in DIMS]).collect():
        used[r["shard"]] = [float(r[d]) for d in DIMS]
    room = full - used
    rest = np.maximum(whole - used.sum(axis=0), 1e-9)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        return placed(frame, room * (frame[list(DIMS)].sum().to_numpy(float) / rest))

    small = pieces.where("not wide").withColumn("block", F.pmod("group", F.lit(blocks))).groupBy("block").applyInPandas(block, schema)
    where = wide.unionByName(small)
    out = salted.join(where, ["group", "salt"])
    part = max(1, min(MAX_BLOCKS, (total["rows"] or 0) // (shards * SLOT_ROWS)))
    out = stash(out.withColumn("part", F.pmod(F.xxhash64(id_col, "group"), F.lit(part))), "shard-placed")
    counts = out.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy(id_col, "text_crc32", "size")) - 1
    return out.withColumn("number", number).join(before, ["shard", "part"]).select(
        id_col, "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
