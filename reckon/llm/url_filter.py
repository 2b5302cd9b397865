"""URL filters: allow and block rules in a trie over reversed host labels and path segments; the longest match decides.

A rule is a host and a path. It fits its host and every subdomain where the url's path starts with the rule's path.
The trie leads from the last host label to the first and from there along whole path segments; a rule's last,
maybe unfinished segment is kept at the node it ends in. Of all rules that fit, the one with the longest host decides,
and of those the one with the longest path.

Rules of at most ``TRIE_BYTES`` are broadcast as a trie: a map over the urls without shuffle. A larger set of rules
meets the distinct hosts of the urls by equality of host suffixes instead, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.durable import stash

#: Most bytes of rules that are broadcast. A trie in a Python worker takes about ten times as much.
TRIE_BYTES = 8 << 20
#: The verdict on urls that no rule fits.
UNLISTED = "allow"
VERDICTS = ("allow", "block")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_column(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_column(url: Column) -> Column:
    """What stands behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Rules by reversed host labels, then by whole path segments; nodes are numbers and edges one dictionary."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.paths: dict[int, int] = {}  # the path root of a host node
        self.ends: dict[int, dict[str, tuple[str, str]]] = {}  # last segments of the rules that end in a path node
        self.nodes = 1
        for host, path, verdict in rules:
            at = 0
            for label in reversed(host.split(".")):
                at = self._step(at, label)
            if at not in self.paths:
                self.paths[at] = self._new()
            at = self.paths[at]
            *whole, last = path.split("/")
            for segment in whole:
                at = self._step(at, segment)
            here = self.ends.setdefault(at, {})
            if last not in here or verdict == "block":  # of equal rules the block entry holds
                here[last] = (host + path, verdict)

    def _new(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def _step(self, at: int, label: str) -> int:
        there = self.edges.get((at, label))
        if there is None:
            there = self.edges[at, label] = self._new()
        return there

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The name and the verdict of the longest rule that fits."""
        roots, at = [], 0
        for label in reversed(host.split(".")):
            at = self.edges.get((at, label))
            if at is None:
                break
            if at in self.paths:
                roots.append(self.paths[at])
        segments = path.split("/") if roots else []
        for root in reversed(roots):
            best, at = None, root
            for segment in segments:
                ends = self.ends.get(at)
                if ends:
                    # a rule's last segment is the beginning of the url's
                    best = next((ends[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in ends), best)
                at = self.edges.get((at, segment))
                if at is None:
                    break
            if best:
                return best
        return None


def _clean(rules: DataFrame) -> DataFrame:
    """Rules without nulls, hosts in lower case; other verdicts than allow and block are an error."""
    ok = F.col("verdict").isin(*VERDICTS)
    verdict = F.when(ok, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("no verdict: "), F.col("verdict"))))
    return rules.where("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), "path", verdict.alias("verdict"))


def _by_trie(parsed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    shared = parsed.sparkSession.sparkContext.broadcast(rules)
    kind = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    @F.pandas_udf(kind)
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)  # once a task
        for hosts, paths in parts:
            found = [trie.find(h, p) or (None, UNLISTED) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return parsed.withColumn("__judged", judge("__host", "__path"))


def _by_suffix(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins: distinct hosts with rules by host suffix, then urls with the rules of their host.

    A rule's paths travel as one list a host, so a url meets one row; the first join has a row a label of each distinct
    host, and a hot host is one row of it.
    """
    hosts = parsed.select("__host").distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    entry = F.struct(F.length("host").alias("deep"), F.length("path").alias("long"), (F.col("verdict") == "block").alias("block"), "path", F.concat("host", "path").alias("rule"), "verdict")
    by_host = rules.distinct().groupBy("host").agg(F.collect_list(entry).alias("entries"))
    met = hosts.select("__host", F.explode(suffixes).alias("host")).join(by_host, "host")
    listed = stash(met.groupBy("__host").agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries")), "host-rules")
    fits = F.filter("entries", lambda e: F.col("__path").startswith(e["path"]))
    best = F.element_at(F.when(F.size(fits) > 0, fits), -1)
    out = parsed.join(listed, "__host", "left").withColumn("__best", best)
    judged = F.struct(F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(UNLISTED)).alias("verdict"))
    return out.withColumn("__judged", judged).drop("entries", "__best")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: list[str] | None = None, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (host and path of the deciding rule, else null) and ``verdict`` to each row.

    ``rules`` has (host, path, verdict), verdict ``allow`` or ``block``; rules with a null field are left out, hosts count
    in lower case, repeated rules count once, and of an allow and a block entry for the same place the block entry
    holds. A url that no rule fits is ``UNLISTED``. Null urls and urls without ``://`` have an empty host and path. A port or
    user name is part of the host as written. Carried columns of these names give way; an empty table gives no rows.
    """
    made = ("host", "path", "rule", "verdict")
    carried = [c for c in (pages.columns if keep is None else keep) if c not in made]
    url = F.col(f"`{url_col}`").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("_"))
    parsed = pages.select(row.alias("__row"), host_column(url).alias("__host"), path_column(url).alias("__path"))
    rules = stash(_clean(rules), "url-rules")
    weight = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    if weight <= trie_bytes:
        judged = _by_trie(parsed, [tuple(r) for r in rules.select("host", "path", "verdict").collect()])
    else:
        judged = _by_suffix(parsed, rules)
    back = [F.col("__row").getField(c).alias(c) for c in carried]
    return judged.select(*back, F.col("__host").alias("host"), F.col("__path").alias("path"), "__judged.rule", "__judged.verdict")


#: The rules that the registered query applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

ORACLE = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
parts AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (
  SELECT s.n, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host) * 1000 + length(r.path)) AS b
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.n)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, '{UNLISTED}') AS verdict FROM split LEFT JOIN best USING (n)
"""
