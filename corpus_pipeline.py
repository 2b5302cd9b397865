"""A corpus pipeline over ``documents``: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Each works on all rows that the stage before kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.durable import stash
from reckon.llm import decontam, language, mixing, sharding, simhash
from reckon.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its pooled probability is so many times what guessing among the learned languages gives.
ABOVE_CHANCE = 1.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language: null texts, texts without letters, and those the model cannot tell.

    Equal texts go or stay together; repeated rows stay repeated. With one learned language there is nothing to
    tell, so every text with a letter stays; with none, nothing does.
    """
    model = language.fit(docs, ~held_out(3, 1))
    out = language.identify(docs.select(*COLUMNS), model)
    known = len(model.langs) if model else 0
    least = ABOVE_CHANCE / known if known > 1 else 0.0
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by fingerprints: the one of least id, then of least text hash.

    The kept rows are found on narrow columns; texts take part in one join only, as its streamed side.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")), "lang", "source", "n_chars")
    found = simhash.near_duplicates(docs.select("doc_id", "text", key.alias("row_key")), keep=["doc_id", "row_key"])
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "fp")
    groups = found.withColumn("group", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")))
    kept = stash(groups.groupBy("group").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("id"), F.col("p.row_key").alias("key")), "kept-documents")
    rows = docs.select(*COLUMNS).withColumn("row_key", key)
    out = rows.join(kept, rows["doc_id"].eqNullSafe(kept["id"]) & (F.col("row_key") == F.col("key")), "left_semi")
    return _first_of_equals(out).select(*COLUMNS)


def _first_of_equals(rows: DataFrame) -> DataFrame:
    """One of the rows that agree in id and row key. Only keys that occur twice meet in an aggregation."""
    twice = rows.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("id2"), F.col("row_key").alias("key2"))
    twice = stash(twice, "repeated-documents")
    if twice.isEmpty():
        return rows
    same = rows["doc_id"].eqNullSafe(twice["id2"]) & (rows["row_key"] == twice["key2"])
    again = rows.join(twice, same, "left_semi").groupBy("doc_id", "row_key").agg(*[F.first(c).alias(c) for c in COLUMNS[1:]])
    return rows.join(twice, same, "left_anti").unionByName(again.select(rows.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark passages make up at least one word in twenty. Repeated rows share their fate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_contamination(docs.select(*COLUMNS), benchmark).where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; what it takes of a last round is cut behind that word.

    Rows are put into the order of the schedule: partition by partition, each sorted by slot, so that the files
    written are consecutive stretches of the mix. Documents of one block follow each other by their ids' digests;
    repeated rows stand side by side.
    """
    mixed = mixing.mix(docs.select(*COLUMNS)).where("taken > 0")
    left = F.least(F.col("size"), F.col("taken") - F.col("round") * F.col("size"))
    out = mixed.select("*", F.posexplode("slots").alias("round", "slot")).withColumn("left", left)
    # the text up to the end of word number ``left``
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("left").cast("int")), "")
    text = F.when(F.col("left") < F.col("size"), cut).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(F.col("left") < F.col("size"), F.length("text")).otherwise(F.col("n_chars")))
    stretches = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # slots hold equally many words, so equal ranges of them are equal shares of the mix
    stretch = F.least(F.floor(F.col("slot") * stretches / F.col("schedule_slots")), F.lit(stretches - 1))
    return out.repartitionById(stretches, stretch.cast("int")).sortWithinPartitions("slot", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).select(*COLUMNS)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place what is left into 24 shards of near equal bytes; equal texts are one group and stay together."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard_documents),
]

#: Neither the network of the first stage nor the packing of the last can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage-{name}")
    return docs
