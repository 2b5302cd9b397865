"""Intermediate results that outlive a lost executor.

Lineage is cut by writing a Parquet table below the shared folder that the session names in
``spark.checkpoint.dir``. Where that setting is empty, a session of local threads gets a folder of its own; on a
cluster there is none that all executors see, so it is an error. A result may read its tables for as long as it is
used; ``release`` deletes all of a session's, once results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="reckon-")
    return _local[app]


def stash(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, in folders by the columns ``by``, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this session has stashed; results that are not written yet can no longer be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stashed table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark).removeprefix("file://")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.removeprefix("file://").removeprefix("file:").startswith(root):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
