"""Vector code compression: each of a vector's parts is coded by the nearest entry of its position's codebook.

Codebooks come from Lloyd's method with resident members. Parts live with their owner, which is (position, entry,
salt): a home partition holds all members of its owners. In each round a home compares its members with the broadcast
codebooks; those that stay are kept where they are, in the home's own files, and only those whose nearest entry
changed migrate in the next shuffle. Then each owner sums up its residents, and the sums of an entry's owners
(one a salt) give its new value. Equal parts of a batch travel as one member with a count, and the salts spread an
entry that has most of the members over all homes.

Codebooks have at most ``ENTRIES`` entries a position, so what is broadcast and what the driver gathers is bounded by
the length of one vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.durable import drop_stash, stash
from reckon.llm.vectors import floors, pack, products, unpack, usable

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Whole numbers beyond this (components of over 131072) count as this, so that sums of squares fit 63 bits.
LIMIT = 1 << 27
OWNER = ("position", "entry", "salt")
MEMBER = "position int, entry int, salt int, part binary, n long"


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Where a vector is cut: consecutive parts of equal length; of an uneven length the first parts have one more."""
    edge = np.cumsum([0] + [width // parts + (i < width % parts) for i in range(parts)]).tolist()
    return list(zip(edge, edge[1:]))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of least squared distance of each row, the first of equals, and that distance. All exact."""
    gap = (book * book).sum(axis=1)[None] - 2 * products(rows, book)
    at = gap.argmin(axis=1)
    return at, (rows * rows).sum(axis=1) + gap[np.arange(len(rows)), at]


def _salts(rows: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(n)).astype(np.int32)


def _member_batch(position: int, entry: np.ndarray, rows: np.ndarray, n: np.ndarray, salts: int, *more: pa.Array) -> list[pa.Array]:
    return [pa.array(np.full(len(rows), position, np.int32)), pa.array(entry.astype(np.int32)), pa.array(_salts(rows, salts)), pack(rows), pa.array(n), *more]


def first_codebooks(rows: DataFrame, width: int, id_col: str, col: str) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids, ascending; of several vectors of an id the least one counts."""
    ids = [r[0] for r in rows.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(id_col).limit(ENTRIES).collect()]
    whole = F.transform(col, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    if not ids:
        return []
    chosen = rows.where(F.col(id_col).between(ids[0], ids[-1])).groupBy(id_col).agg(F.min(whole).alias("v")).orderBy(id_col).collect()
    start = np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), width)
    return [start[:, lo:hi] for lo, hi in bounds(width, PARTS)]


def _first_members(rows: DataFrame, width: int, col: str, books: list[np.ndarray], salts: int) -> DataFrame:
    """All parts with their nearest entries, equal parts of a batch counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = floors(batch.column(0), width, SCALE, LIMIT)
            for position, (lo, hi) in enumerate(bounds(width, PARTS)):
                parts, n = np.unique(whole[:, lo:hi], axis=0, return_counts=True) if hi > lo else (whole[:1, lo:hi], np.array([len(whole)]))
                at, _ = nearest(parts, books[position])
                yield pa.RecordBatch.from_arrays(_member_batch(position, at, parts, n[: len(parts)].astype(np.int64), salts), names=[*OWNER, "part", "n"])

    return rows.select(col).mapInArrow(run, MEMBER)


def _judged(members: DataFrame, width: int, books: list[np.ndarray], salts: int) -> DataFrame:
    """The members with their entries in the new codebooks, and whether they leave their home's owner."""
    cuts = bounds(width, PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_numpy()
            for position in np.unique(places):
                mine = batch.filter(pa.array(places == position))
                rows = unpack(mine.column(3), cuts[position][1] - cuts[position][0])
                at, _ = nearest(rows, books[position])
                moved = pa.array(at != mine.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays(_member_batch(position, at, rows, mine.column(4).to_numpy(), salts, moved), names=[*OWNER, "part", "n", "moved"])

    return members.select(*OWNER, "part", "n").mapInArrow(run, MEMBER + ", moved boolean")


def _updated(members: DataFrame, width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks of the whole parts of their members' means; an entry without members stays.

    A home adds up its residents by owner, entries add up their owners.
    """
    cuts = bounds(width, PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            places = batch.column(0).to_numpy()
            for position in np.unique(places):
                mine = batch.filter(pa.array(places == position))
                entry, n = mine.column(1).to_numpy(), mine.column(4).to_numpy()
                rows = unpack(mine.column(3), cuts[position][1] - cuts[position][0])
                order = np.argsort(entry, kind="stable")
                first = np.flatnonzero(np.diff(entry[order], prepend=-1))
                weighed = np.concatenate([rows * n[:, None], n[:, None]], axis=1)[order]
                sums[position][entry[order][first]] += np.add.reduceat(weighed, first, axis=0)
        for position, table in enumerate(sums):
            used = np.flatnonzero(table[:, -1])
            if len(used):
                flat = pa.array(table[used].reshape(-1))
                ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * table.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), position, np.int32)), pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(ends, flat)], names=["position", "entry", "sums"])

    partial = members.select(*OWNER, "part", "n").mapInArrow(run, "position int, entry int, sums array<long>")
    each = partial.select("position", "entry", F.posexplode("sums").alias("at", "value")).groupBy("position", "entry", "at").agg(F.sum("value").alias("value"))
    new = [np.concatenate([b, np.zeros((len(b), 1), np.int64)], axis=1) for b in books]
    for r in each.groupBy("position", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums")).collect():
        *total, n = r["sums"]
        new[r["position"]][r["entry"], :-1] = np.array(total, np.int64) // n
    return [b[:, :-1] for b in new]


def fit_codebooks(rows: DataFrame, width: int, id_col: str, col: str, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook [entries, part length] for each part position, from usable vectors."""
    spark = rows.sparkSession
    homes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    books = first_codebooks(rows, width, id_col, col)
    if not books:
        return []
    members = stash(_first_members(rows, width, col, books, homes).repartition(homes, *OWNER), "members")
    books = _updated(members, width, books)
    for _ in range(rounds - 1):
        judged = stash(_judged(members, width, books, homes), "judged-members", by=("moved",))
        drop_stash(members)
        arrived = stash(judged.where("moved").repartition(homes, *OWNER), "arrived-members")
        members = judged.where("not moved").unionByName(arrived)
        books = _updated(members, width, books)
    drop_stash(members)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(rows: DataFrame, width: int, col: str, books: list[np.ndarray], keep: list[str]) -> DataFrame:
    """Append ``code`` (an index a part, two hex digits each) and ``error`` (squared distance) to usable vectors."""
    kept = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{col}`").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = floors(batch.column(1), width, SCALE, LIMIT)
            found = [nearest(whole[:, lo:hi], b) for (lo, hi), b in zip(bounds(width, PARTS), books)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = sum(gap for _, gap in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(error, pa.int64())], names=["row", "code", "error"])

    kind = kept.schema["row"].dataType.simpleString()
    out = kept.mapInArrow(run, f"row {kind}, code string, error long")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every usable vector, repeated rows included.

    Vectors that are null, empty, hold a null or non-finite component, or have another length than most are dropped.
    Rows without an id are coded but start no entry; with fewer than ``ENTRIES`` ids the codebooks are smaller, and with
    no id at all there is nothing to code by and no row. Errors of rows without a label are summed together.
    """
    rows, width = usable(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{col}`").alias("v")), "v")
    books = fit_codebooks(rows, width, "id", "v") if width else []
    if not books:
        coded = rows.limit(0).select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = stash(encode(rows, width, "v", books, ["id", "label"]), "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: one nearest-entry query and one update for each round."""
    squares = "list_inner_product(b.e, b.e) - 2 * list_inner_product(p.v, b.e)"
    near = lambda book: f"SELECT p.vec_id, p.pos, p.v, arg_min(b.entry, ({squares}, b.entry)) AS entry, min({squares}) + list_inner_product(p.v, p.v) AS gap FROM parts p JOIN {book} b USING (pos) GROUP BY p.vec_id, p.pos, p.v"
    steps, book = [], "book0"
    for r in range(1, ROUNDS + 1):
        steps.append(f"near{r} AS MATERIALIZED ({near(book)})")
        steps.append(f"mean{r} AS MATERIALIZED (SELECT pos, entry, list(m ORDER BY i) AS e FROM (SELECT pos, entry, i, floor(sum(x) / count(*)) AS m FROM (SELECT pos, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM near{r}) GROUP BY ALL) GROUP BY ALL)")
        steps.append(f"book{r} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN mean{r} m USING (pos, entry))")
        book = f"book{r}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT vec_id, pos, list_slice(w, pos * len(w) // {PARTS} + 1, (pos + 1) * len(w) // {PARTS}) AS v FROM kept, range({PARTS}) t(pos)),
start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS MATERIALIZED (SELECT pos, entry, v AS e FROM parts JOIN start USING (vec_id)),
{", ".join(steps)},
final AS MATERIALIZED ({near(book)}),
coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY pos) AS code, CAST(sum(gap) AS BIGINT) AS error FROM final GROUP BY vec_id),
numbers AS (SELECT pos, entry, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM {book})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY pos, entry, i)) FROM numbers) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLE = _oracle()
