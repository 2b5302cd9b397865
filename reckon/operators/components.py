"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from reckon.durable import drop_stash, stash


def _hook(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node (the larger ones, or all not larger) to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger_only:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if larger_only:
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def by_component(rows: DataFrame, key: str = "component") -> GroupedData:
    """Rows grouped for a solver in Python. Components are small and the solver slow, so they are dealt to all cores: a
    plain shuffle would be coalesced by its bytes into a task or two."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key).groupBy(key)


def solve_groups(rows: DataFrame, solve: Callable[[list], list[tuple]], schema: str, *keys: str) -> DataFrame:
    """What ``solve`` makes of the rows (named tuples) of each group, group by group, in streams of sorted rows.

    Groups are told apart by ``keys``, by default the component.

    For many small groups: a frame for each would cost more than its solution. Groups are dealt to all cores.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kind = to_arrow_schema(StructType.fromDDL(schema))
    Row = namedtuple("Row", rows.columns)
    keys = keys or ("component",)
    at = [rows.columns.index(k) for k in keys]
    of = lambda row: [row[i] for i in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        made: list[tuple] = []
        for batch in batches:
            for row in map(Row._make, zip(*(c.to_pylist() for c in batch.columns))):
                if held and of(row) != of(held[0]):
                    made += solve(held)
                    held = []
                held.append(row)
            if made:
                yield _batch(made, kind)
                made = []
        made = solve(held) if held else []
        if made:
            yield _batch(made, kind)

    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """One row (node, component) for each node that some edge joins to another node.

    ``component`` is the least node of the component. Each round contracts every neighbourhood onto its
    least member (first among larger neighbours, then among smaller ones), so rounds grow with the
    logarithm of the longest chain. Rows with a null end and loops are ignored; an empty table gives an
    empty result. State is written to the shared folder after each round.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = stash(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        new = stash(_hook(_hook(now, True), False), "edges")
        # a forest of stars: no node has two parents and no parent has a parent
        tall = new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        twice = tall or new.groupBy("a").count().where("count > 1").limit(1).count()
        drop_stash(now)
        now = new
        if not tall and not twice:
            child = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            root = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return child.unionAll(root)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
