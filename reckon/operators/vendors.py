"""Vendor resolution: narration names to the names of a vendor master, for many runs at once.

All similarity is computed on distinct names, and only for names that ``name_join`` lets meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reckon.durable import stash
from reckon.functions.scalars import display_name, initials, upi_handle
from reckon.functions.similarity import jaro_winkler, skeleton, token_column, tokens
from reckon.operators.name_join import similar_pairs
from reckon.operators.numbering import numbered

def similar_names(names: DataFrame, master: DataFrame, least: float) -> DataFrame:
    """(run_id, vendor, master, similarity) of names of a run that reach ``least`` with a master name of the run.

    ``names`` has (run_id, vendor), ``master`` (run_id, master). Each distinct pair of names is compared once, whatever
    number of runs it occurs in.
    """
    near = similar_pairs(names.select("vendor"), master.select("master"), least)
    return names.select("run_id", "vendor").distinct().join(near, "vendor").join(master.select("run_id", "master").distinct(), ["run_id", "master"])


@F.pandas_udf(T.BooleanType())
def lead_token_agrees(name: pd.Series, candidate: pd.Series) -> pd.Series:
    """Whether the first word of a name is close to some word of the candidate."""
    out, ask = [], []
    for i, (a, b) in enumerate(zip(name, candidate)):
        lead = tokens(a)[:1]
        out.append(not lead)
        for t in lead:
            for c in tokens(b):
                long = len(t) >= 3 and len(c) >= 3
                if t == c or (long and (t.startswith(c) or c.startswith(t) or skeleton(t) in (skeleton(c), c) or t == skeleton(c))):
                    out[i] = True
                else:
                    ask.append((i, t, c))
    for (i, _, _), s in zip(ask, jaro_winkler([t for _, t, _ in ask], [c for _, _, c in ask])):
        out[i] = out[i] or bool(s >= 0.85)
    return pd.Series(out, dtype=bool)


def vendor_master(txns: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, master, ord): names of the run's ledger in order of first row, then those of other finished runs, sorted."""
    ledger = txns.where("side = 'ledger' and vendor is not null and vendor <> ''")
    own = ledger.groupBy("run_id", F.col("vendor").alias("master")).agg(F.min("ord").alias("first"))
    done = runs.where(F.col("status").isin("completed", "awaiting_review")).select("run_id")
    counts = ledger.join(done, "run_id").select("run_id", F.col("vendor").alias("master")).distinct()
    every = counts.groupBy("master").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("only"))
    # names of other runs: all of them for every run, less those that only the run itself has
    elsewhere = runs.select("run_id").withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one").where((F.col("n") > 1) | (F.col("only") != F.col("run_id")))
    both = own.select("run_id", "master", F.lit(0).alias("far"), "first").unionByName(elsewhere.select("run_id", "master", F.lit(1).alias("far"), F.lit(None).cast("long").alias("first")))
    once = both.groupBy("run_id", "master").agg(F.min("far").alias("far"), F.min("first").alias("first"))
    return once.select("run_id", "master", F.row_number().over(W.partitionBy("run_id").orderBy("far", "first", "master")).alias("ord"))


@dataclass(frozen=True)
class Masters:
    """The names that each run knows, without a row for each run and name: ``own`` (run_id, master, first) of a run's ledger
    with its first row, and ``shared`` (master), the names of all finished runs. A run knows its own and all shared ones."""

    own: DataFrame
    shared: DataFrame


def masters_of(txns: DataFrame, runs: DataFrame) -> Masters:
    """The names of ledger rows by run, and those of finished runs. Each is one aggregation."""
    ledger = txns.where("side = 'ledger' and vendor is not null and vendor <> ''")
    own = ledger.groupBy("run_id", F.col("vendor").alias("master")).agg(F.min("ord").alias("first"))
    done = runs.where(F.col("status").isin("completed", "awaiting_review")).select("run_id")
    return Masters(stash(own, "own-masters"), stash(own.join(done, "run_id", "left_semi").select("master").distinct(), "shared-masters"))


def known_matches(names: DataFrame, masters: Masters, least: float = 0.9) -> DataFrame:
    """``master_matches`` against what each run knows: its own names first by their first row, then the shared ones in order.

    Names are compared once each, whatever number of runs holds them; runs come in only with the pairs that are similar.
    An initialism must name one of all names that the run knows.
    """
    asked = names.select("run_id", "vendor").distinct()
    every = masters.own.select("master").unionByName(masters.shared).distinct()
    near = similar_pairs(asked.select("vendor"), every, least).where(lead_token_agrees("vendor", "master"))
    shared = masters.shared.withColumn("shared", F.lit(True))
    met = asked.join(stash(near, "near-masters"), "vendor").join(masters.own, ["run_id", "master"], "left").join(shared, "master", "left").where("first is not null or shared")
    order = F.struct(-F.col("similarity"), F.col("first").isNull(), "first", "master")
    best = met.groupBy("run_id", "vendor").agg(F.min_by("master", order).alias("close"))
    short = lambda df: df.withColumn("word", initials(F.col("master"))).where("word <> ''")
    common = short(masters.shared).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("master").alias("master"))
    apart = short(masters.own.select("run_id", "master").join(masters.shared, "master", "left_anti")).groupBy("run_id", "word").agg(F.count(F.lit(1)).alias("m"), F.min("master").alias("alone"))
    words = asked.select("run_id", "vendor", F.posexplode(token_column(F.col("vendor"))).alias("at", "word")).where(F.length("word").between(3, 5))
    one = words.join(common, "word", "left").join(apart, ["run_id", "word"], "left").where(F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) == 1)
    brand = one.groupBy("run_id", "vendor").agg(F.min_by(F.coalesce("master", "alone"), "at").alias("brand"))
    out = asked.join(best, ["run_id", "vendor"], "left").join(brand, ["run_id", "vendor"], "left")
    return out.select("run_id", "vendor", F.coalesce("close", "brand").alias("matched"))


def alias_hits(rows: DataFrame, aliases: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Add ``alias_rule`` and ``alias_name`` of the first rule (id, canonical, aliases) contained in the narration."""
    up = F.upper("narration")
    rule, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_id, canonical, words in reversed(aliases):
        hit = F.lit(False)
        for w in words:
            if w:
                hit = hit | up.contains(w.upper())
        rule, name = F.when(hit, rule_id).otherwise(rule), F.when(hit, canonical).otherwise(name)
    return rows.withColumn("alias_rule", rule).withColumn("alias_name", name)


def master_matches(names: DataFrame, master: DataFrame, least: float = 0.9) -> DataFrame:
    """(run_id, vendor, matched): the most similar master name whose words agree with the leading one, the first of
    equals; else the only master name whose initials are a word of three to five letters, the first such word."""
    near = similar_names(names, master, least).where(lead_token_agrees("vendor", "master")).join(master, ["run_id", "master"])
    best = near.withColumn("n", F.row_number().over(W.partitionBy("run_id", "vendor").orderBy(F.desc("similarity"), "ord"))).where("n = 1").select("run_id", "vendor", F.col("master").alias("close"))
    short = master.withColumn("word", initials(F.col("master"))).where("word <> ''").groupBy("run_id", "word").agg(F.count(F.lit(1)).alias("n"), F.first("master").alias("master")).where("n = 1")
    words = names.select("run_id", "vendor").distinct().select("run_id", "vendor", F.posexplode(token_column(F.col("vendor"))).alias("at", "word")).where(F.length("word").between(3, 5))
    brand = words.join(short, ["run_id", "word"]).groupBy("run_id", "vendor").agg(F.min_by("master", "at").alias("brand"))
    out = names.select("run_id", "vendor").distinct().join(best, ["run_id", "vendor"], "left").join(brand, ["run_id", "vendor"], "left")
    return out.select("run_id", "vendor", F.coalesce("close", "brand").alias("matched"))


def resolve(rows: DataFrame, master: DataFrame | Masters, aliases: list[tuple[str, str, list[str]]] = []) -> DataFrame:  # noqa: B006
    """Add ``resolved`` to bank rows (run_id, narration, extracted): alias, name match, handle match, display name.

    Names with a dash of our own making (—) are not matched. ``master`` lists (run_id, master, ord), or is what runs know.
    """
    rows = alias_hits(rows, aliases).withColumn("handle", upi_handle(F.col("narration")))
    own = F.col("extracted").contains("—")
    asked = F.array(F.when(~own, F.col("extracted")), F.col("handle"))
    names = rows.select("run_id", F.explode(F.array_compact(asked)).alias("vendor")).distinct()
    # the few names are written: as columns of the plan, their long expressions would be repeated at every use of a name
    names = stash(names, "names")
    found = stash(known_matches(names, master) if isinstance(master, Masters) else master_matches(names, stash(master, "masters")), "matched-names")
    by = lambda c, out: found.select("run_id", F.col("vendor").alias(c), F.col("matched").alias(out))
    rows = rows.join(by("extracted", "by_name"), ["run_id", "extracted"], "left").join(by("handle", "by_handle"), ["run_id", "handle"], "left")
    plain = F.when(own, F.col("extracted")).otherwise(display_name(F.col("extracted")))
    return rows.withColumn("resolved", F.coalesce("alias_name", F.when(~own, F.col("by_name")), "by_handle", plain)).drop("by_name", "by_handle")


def number_rows(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Add ``new_id`` such as B-2609-0001, counted in each prefix by side (bank first), date and file order.

    ``stored`` has (prefix, last) of numbers given before. A month of any size is numbered in as many tasks as it needs.
    """
    prefix = F.concat(F.when(F.col("side") == "bank", "B-").otherwise("L-"), F.date_format("date", "yyMM"), F.lit("-"))
    out = numbered(rows.withColumn("prefix", prefix), "prefix", ["date", "ord", "id"], "n")
    last = F.lit(0)
    if stored is not None:
        out, last = out.join(stored.select("prefix", "last"), "prefix", "left"), F.coalesce("last", F.lit(0))
    value = (F.col("n") + last).cast("string")
    return out.withColumn("new_id", F.concat("prefix", F.when(F.length(value) > 4, value).otherwise(F.lpad(value, 4, "0")))).drop("prefix", "n", "last")


__all__ = ["Masters", "alias_hits", "known_matches", "lead_token_agrees", "master_matches", "masters_of", "number_rows", "resolve", "similar_names", "vendor_master"]
