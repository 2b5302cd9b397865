"""Mixing sources to target weights along a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, shuffled by a digest of their id, form a line of words that is cut into blocks of
equally many words. A golden-ratio sequence is mapped through the cumulative block demand of the sources;
its slots are ranked per source, and the slot of rank r takes block r modulo the source's number of blocks,
so that every prefix of the schedule is mixed almost exactly by weight. A source whose target is more than
its size goes round its line again, at most three times; its last slot is trimmed to meet the target.
Each document is given the slots at which the mix takes it, so that rows sorted by slot are the mixed corpus.

Sources are a catalogue: one narrow row each, ranked in one task, as targets depend on all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reckon.durable import stash

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: A block has at least so many words, and as many more as keep the schedule within MAX_SLOTS blocks; this
#: also bounds the table of blocks that is broadcast.
MIN_BLOCK = 256
MAX_SLOTS = 1 << 17
#: Slots beyond the demand, for points that fall unevenly.
SPARE_SLOTS = 64
BUCKETS = 1024
GOLDEN = 0.6180339887498949
CELLS = 1024
CHUNK = 4096
_LONG = T.DecimalType(38, 0)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab and line breaks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``weight`` and ``target`` (double) to one row per source with its ``source_size``.

    ``s`` and ``s_null`` name the source. Weights repeat along the sources by code point, null last. Targets
    share the sum of all sizes by weight; one that would exceed ``max_epochs`` sizes stops there, and what it
    leaves is shared again: with sources in the order of size to weight, a prefix is capped.
    """
    at = F.row_number().over(W.orderBy("s_null", "s")) - 1
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (at % len(weights)) + 1).cast("long"))
    ratio = W.orderBy(F.col("source_size").cast("double") / F.col("weight"), "s_null", "s")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.col("source_size") * max_epochs
    out = (
        out.withColumn("at", F.row_number().over(ratio))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("capped", cap.cast(_LONG) * F.col("weights_left") <= F.col("left").cast(_LONG) * F.col("weight"))
    )
    first_open = F.min_by(F.struct("left", "weights_left"), F.when(~F.col("capped"), F.col("at"))).over(everything)
    out = out.withColumn("open", first_open)
    shared = F.col("open.left").cast("double") * F.col("weight") / F.col("open.weights_left")
    return out.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(shared)).drop("at", "left", "weights_left", "capped", "open")


def schedule(sources: DataFrame) -> DataFrame:
    """Slots (slot, sid, rank, block, pass) of the whole mix. ``sources`` has sid, blocks and demand (in blocks)."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("demand")).first()[0] or 0
    points = total + SPARE_SLOTS if total else 0
    upper = F.sum("demand").over(W.orderBy("sid")) / F.lit(float(max(total, 1)))
    lines = sources.where("demand > 0").withColumn("hi", upper).withColumn("lo", F.col("hi") - F.col("demand") / F.lit(float(max(total, 1))))
    lines = lines.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("sid")), F.lit(0.0)))
    cells = lines.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    point = F.col("slot").cast("double") * GOLDEN + 0.5
    slots = spark.range(points).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * CELLS))
    met = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = met.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("sid").orderBy("chunk")) - F.col("n"))
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(before.drop("n"), ["sid", "chunk"]).select("slot", "sid", (F.col("rank") + F.col("before")).alias("rank"))
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    short = sources.join(have, "sid", "left").fillna(0, ["have"]).where("have < demand")
    tail = short.select("sid", F.explode(F.sequence(F.col("have"), F.col("demand") - 1)).alias("rank")).select((F.lit(points) + F.col("rank")).alias("slot"), "sid", "rank")
    every = ranked.unionByName(tail).join(sources.select("sid", "blocks", "demand"), "sid").where("rank < demand")
    return every.select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"))


def _line(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source its key, size, target, whole passes and rest; per (source, bucket) the words before it."""
    parts = rows.groupBy("s_null", "s", "bucket").agg(F.sum("size").alias("words"))
    parts = stash(parts, "mix-buckets")
    sources = parts.groupBy("s_null", "s").agg(F.sum("words").alias("source_size"))
    sources = targets(sources).withColumn("sid", F.row_number().over(W.orderBy("s_null", "s")))
    take = F.floor("target")
    size = F.greatest("source_size", F.lit(1))
    total = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    block = F.greatest(F.lit(MIN_BLOCK), F.ceil(total / F.lit(MAX_SLOTS)))
    sources = (
        sources.withColumn("take", take).withColumn("passes", F.floor(take / size)).withColumn("rest", take - F.floor(take / size) * size)
        .withColumn("block_words", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")))
        .withColumn("demand", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / F.col("block_words")))
    )
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sources = stash(sources.withColumn("schedule_slots", F.sum("demand").over(everything) + SPARE_SLOTS), "mix-sources")
    before = F.sum("words").over(W.partitionBy("s_null", "s").orderBy("bucket")) - F.col("words")
    parts = parts.withColumn("before", before).drop("words").join(sources, ["s_null", "s"])
    return sources, parts


def block_takes(sources: DataFrame) -> DataFrame:
    """Per (sid, block) of the schedule: ``base`` words taken from earlier blocks, whole ``times``, ``cut``, and the
    ``slots`` of its passes in order."""
    slots = schedule(sources).join(sources.select("sid", "passes", "rest", "block_words", "source_size"), "sid")
    trimmed = F.col("pass") == F.col("passes")
    start = F.col("block") * F.col("block_words")
    end = F.least(start + F.col("block_words"), F.when(trimmed, F.col("rest")).otherwise(F.col("source_size")))
    slots = slots.withColumn("whole", F.when(trimmed, 0).otherwise(1)).withColumn("words", end - start).withColumn("cut", F.when(trimmed, end))
    passes = F.transform(F.array_sort(F.collect_list(F.struct("pass", "slot"))), lambda x: x["slot"])
    takes = slots.groupBy("sid", "block").agg(F.sum("whole").alias("times"), F.max("cut").alias("cut"), F.sum("words").alias("words"), passes.alias("slots"))
    return takes.withColumn("base", F.sum("words").over(W.partitionBy("sid").orderBy("block")) - F.col("words")).drop("words")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted), ``slots`` and ``schedule_slots``.

    The words taken from a source are the whole part of its target, and no document gives more than three
    times its size. ``slots`` has for each time that the mix comes to a document the schedule's slot of the block
    that its first word stands in; it is empty if nothing is taken. Of ``schedule_slots`` in all, few are left out. Null and wordless texts have size zero and give nothing; a null source is one source,
    the last; repeated rows and equal ids stand side by side on the line, ordered by size, and a null id is
    an empty one; an empty table gives no rows. Carried columns of the same names give way to the new ones.
    """
    made = ["size", "source_size", "target", "taken", "slots", "schedule_slots"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in made]
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), key.alias("key"), word_count(F.col(text_col)).alias("size"),
        F.col(source_col).isNull().alias("s_null"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") / F.lit((1 << 32) // BUCKETS)).cast("int").alias("bucket"),
    )
    rows = stash(rows, "mix-rows")
    sources, parts = _line(rows)
    takes = stash(block_takes(sources), "mix-blocks")
    if takes.count() <= 2 * MAX_SLOTS:  # more only where there are more sources than slots
        takes = F.broadcast(takes)
    line = W.partitionBy("s_null", "s", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(line)).join(parts, ["s_null", "s", "bucket"])
    placed = placed.withColumn("end", F.col("before") + F.col("upto")).withColumn("start", F.col("end") - F.col("size"))
    for side, at in (("start", F.col("start")), ("end", F.greatest(F.col("end") - 1, F.lit(0)))):
        block = F.floor(at / F.col("block_words"))
        found = takes.select(F.col("sid"), F.col("block").alias(f"{side}_block"), F.struct("base", "times", "cut", "slots").alias(f"{side}_take"))
        placed = placed.withColumn(f"{side}_block", block).join(found, ["sid", f"{side}_block"], "left")

    def taken_before(side: str) -> Column:
        got, x, first = F.col(f"{side}_take"), F.col(side), F.col(f"{side}_block") * F.col("block_words")
        part = F.when(got["cut"].isNotNull(), F.greatest(F.least(x, got["cut"]) - first, F.lit(0))).otherwise(0)
        return F.coalesce(got["base"] + got["times"] * (x - first) + part, F.col("take"))

    taken = F.when(F.col("size") == 0, 0).otherwise(taken_before("end") - taken_before("start")).cast("long")
    placed = placed.withColumn("taken", taken)
    rounds = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    slots = F.slice(F.coalesce(F.col("start_take.slots"), F.array().cast("array<bigint>")), F.lit(1), rounds)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in carried], "size", "source_size", "target", "taken", slots.alias("slots"), "schedule_slots")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
r AS (
  SELECT *, row_number() OVER o AS nr,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)),
c AS (SELECT *, 3 * source_size * weights <= rest * weight AS capped FROM r),
f AS (SELECT min_by(rest, nr) AS rest, min_by(weights, nr) AS weights FROM c WHERE NOT capped),
t AS (
  SELECT c.source, c.source_size,
         CASE WHEN capped THEN CAST(3 * c.source_size AS DOUBLE) ELSE CAST(f.rest AS DOUBLE) * c.weight / CAST(f.weights AS DOUBLE) END AS target
  FROM c CROSS JOIN f),
b AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS take, greatest(256, CAST(ceil(sum(source_size) OVER () / 131072) AS BIGINT)) AS bw,
         row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM t),
g AS (
  SELECT *, CAST(ceil(source_size / bw) AS BIGINT) AS blocks, take // greatest(source_size, 1) AS passes, take - take // greatest(source_size, 1) * source_size AS rest FROM b),
e AS (SELECT *, CAST(passes * blocks + ceil(rest / bw) AS BIGINT) AS demand FROM g),
n AS (SELECT CAST(sum(demand) AS BIGINT) AS total, CAST(sum(demand) AS BIGINT) + 64 AS points FROM e),
q AS (SELECT sid, demand, CAST(sum(demand) OVER (ORDER BY sid) AS DOUBLE) / CAST(total AS DOUBLE) AS hi FROM e, n WHERE demand > 0),
v AS (SELECT sid, demand, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo, hi FROM q),
u AS (
  SELECT slot, CAST(slot AS DOUBLE) * CAST(0.6180339887498949 AS DOUBLE) + 0.5 AS x
  FROM (SELECT unnest(range(0, points)) AS slot FROM n WHERE total > 0)),
met AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM u JOIN v ON x - floor(x) >= lo AND x - floor(x) < hi),
every AS (
  SELECT sid, rank, slot FROM met
  UNION ALL
  SELECT sid, rank, points + rank FROM (
    SELECT v.sid, unnest(range(coalesce(h.have, 0), v.demand)) AS rank
    FROM v LEFT JOIN (SELECT sid, count(*) AS have FROM met GROUP BY sid) h ON h.sid = v.sid), n),
p AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         row_number() OVER () AS row FROM d),
j AS (
  SELECT p.row, p.doc_id, p.size, p.upto, e.source_size, e.target, e.sid, e.bw, e.blocks,
         CAST(CASE WHEN p.size = 0 THEN 0 ELSE (take // e.source_size) * p.size
              + greatest(0, least(upto, take % e.source_size) - (upto - p.size)) END AS BIGINT) AS taken
  FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source),
o AS (
  SELECT row, string_agg(CAST(slot AS VARCHAR), ',' ORDER BY rank) AS slots
  FROM (SELECT row, sid, unnest(range(0, CAST(ceil(taken / size) AS BIGINT))) * blocks + (upto - size) // bw AS rank FROM j WHERE taken > 0)
  JOIN every USING (sid, rank) GROUP BY row)
SELECT doc_id, size, source_size, target, taken, coalesce(slots, '') AS slots FROM j LEFT JOIN o USING (row)
"""
