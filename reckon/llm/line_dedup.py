"""Removal of repeated runs of words, by winnowing over word hashes.

Within a document a gram is a run of ``GRAM_WORDS`` words and a window a run of ``RUN_WORDS`` words, from every
word on. The gram of least hash within a window is its fingerprint: it depends on the window's words alone, so
copies of a window share it. Fingerprints that stand at one position only are taken away; the windows of the
others are hashed, and every window but the first of its content is deleted. Deleted windows overlap, so a
match covers all words of a run wherever it starts or ends, within a line or across lines.
First positions come from aggregations of numbers, so no pairs of a group are ever formed, and what is kept of
a document is what it has less what stands alone or first: nothing is joined by content.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.durable import stash
from reckon.llm.common import NONSPACE, SLICE_BYTES, find_words, give_back_memory, hash_words, map_texts, utf8

RUN_WORDS = 50
GRAM_WORDS = 25
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


#: Places are numbers: a document's number in the order of ids, then 30 bits for a word of it.
_WORD_BITS = 30
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def winnow(hashes: np.ndarray, first: np.ndarray, run_words: int, gram_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, fingerprint's word and content hash of every window within a text, and the hashes of all grams.

    ``hashes`` are the words of several texts one after another, ``first`` the number of each text's first word.
    """
    n = len(hashes)
    if n < run_words:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _MIX, np.uint64)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(int(_MIX), -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    chain = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers, out=chain[1:])

    def runs(size: int) -> np.ndarray:
        h = (chain[size:] - chain[: n - size + 1]) * back[: n - size + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    gram = runs(gram_words)
    best, width, wanted = np.arange(len(gram)), 1, run_words - gram_words + 1
    while width < wanted:
        step = min(width, wanted - width)
        a, b = best[:-step], best[step:]
        best = np.where(gram[b] < gram[a], b, a)
        width += step
    end = np.repeat(first[1:], np.diff(first))[: n - run_words + 1]
    start = np.flatnonzero(np.arange(n - run_words + 1) + run_words <= end)
    return start, best[start], runs(run_words)[start].view(np.int64), gram.view(np.int64)


def _per_text(first: np.ndarray, at: np.ndarray, names: list[str], columns: list[np.ndarray]) -> pa.Array:
    """Structs at ascending words ``at`` as one list for each text."""
    values = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), values)


def _owner(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return first[np.searchsorted(first, at, "right") - 1]


def _prints(run_words: int, gram_words: int):
    def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
        starts, ends, first = find_words(data, offsets, NONSPACE)
        _, at, _, gram = winnow(hash_words(data, starts, ends), first, run_words, gram_words)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        feeds = np.diff(np.searchsorted(np.flatnonzero(data == 10), offsets))
        full = np.diff(offsets) > 0
        open_end = np.zeros(len(full), bool)
        open_end[full] = data[offsets[1:][full] - 1] != 10
        prints = _per_text(first, at, ["print", "at"], [gram[at], (at - _owner(first, at)).astype(np.int32)])
        return [pa.array(feeds + open_end, pa.int64()), pa.array(np.diff(first), pa.int64()), prints]

    return f


def _packed(batches):
    """Rows (id, text_key, text) with the text compressed, as it is about to be shuffled."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([packer.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["id", "text_key", "packed"])


def _unpacked(packed: pa.Array):
    """Ranges of rows and their texts, a range holding ``SLICE_BYTES`` of text or little more, or one longer text."""
    reader = zstandard.ZstdDecompressor()
    lo, texts, size = 0, [], 0
    for i, x in enumerate(packed):
        texts.append(reader.decompress(x.as_buffer()))
        size += len(texts[-1])
        if size >= SLICE_BYTES or i + 1 == len(packed):
            yield lo, i + 1, pa.array(texts, pa.binary()).cast(pa.string())
            lo, texts, size = i + 1, [], 0


def _shared_windows(run_words: int, gram_words: int):
    """Rows (doc, packed text, alone) to (doc, windows): the windows whose fingerprint's word is not in ``alone``."""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in _unpacked(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                data, offsets = utf8(texts)
                starts, ends, first = find_words(data, offsets, NONSPACE)
                start, at, content, _ = winnow(hash_words(data, starts, ends), first, run_words, gram_words)
                counts = pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
                alone = np.zeros(len(starts) + 1, bool)
                alone[np.repeat(first[:-1], counts) + part.column(2).flatten().to_numpy(zero_copy_only=False)] = True
                shared = ~alone[at]
                start, content = start[shared], content[shared]
                windows = _per_text(first, start, ["start", "content"], [(start - _owner(first, start)).astype(np.int32), content])
                yield pa.RecordBatch.from_arrays([part.column(0), windows], names=["doc", "windows"])
        give_back_memory()

    return run


def _later_spans(run_words: int):
    """Rows (doc, starts, origins) to (doc, spans): merged words of the windows that start at no origin."""

    def run(batches):
        for batch in batches:
            rows = []
            for starts, origins in zip(batch.column(1), batch.column(2)):
                s = starts.values.to_numpy()
                s = np.unique(s[~np.isin(s, origins.values.to_numpy())] if origins.is_valid else s)
                if not len(s):
                    rows.append([])
                    continue
                new = np.flatnonzero(np.diff(s) > run_words)
                heads, tails = s[np.concatenate([[0], new + 1])], s[np.concatenate([new, [len(s) - 1]])] + run_words - 1
                rows.append([{"first": a, "last": b} for a, b in zip(heads.tolist(), tails.tolist())])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc", "spans"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """(id, text_key, doc): the distinct documents numbered from 0 in the order of id, null last, and text key."""
    order = docs.select("id", "text_key").distinct().orderBy(F.col("id").isNull(), "id", "text_key")
    sorted_ = stash(order.withColumn("n", F.monotonically_increasing_id()), "document-order")
    part = F.shiftright("n", 33)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("before"))
    within = F.col("n").bitwiseAND((1 << 33) - 1)
    return sorted_.withColumn("part", part).join(F.broadcast(before), "part").select("id", "text_key", (within + F.col("before")).alias("doc"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """One row per document: id, ``text_key``, ``n_lines``, ``n_words``, and ``spans``, the merged word ranges to delete.

    A word is deleted if it lies in a run of ``run_words`` words (cases of A-Z and white space ignored) that
    also stands at an earlier position, in the order of id (null last), text key and word. Words are numbered
    from 0. Null and empty texts have no span; rows with equal id and text are one document and lose the same
    words; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _text_key(text_col).alias("text_key"))
    place = T.StructType([T.StructField("print", T.LongType()), T.StructField("at", T.IntegerType())])
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("prints", T.ArrayType(place))]
    found = stash(map_texts(base, fields, lambda: _prints(run_words, gram_words), keep=["id", "text_key"]), "word-prints")
    same = lambda a, b: a["id"].eqNullSafe(b["id2"]) & (a["text_key"] == b["key2"])
    number = _numbered(found).select(F.col("id").alias("id2"), F.col("text_key").alias("key2"), "doc")
    known = stash(found.join(number, same(found, number)).drop("id2", "key2"), "numbered-prints")
    spot = F.shiftleft("doc", _WORD_BITS)
    doc_of, word_of = lambda c: F.shiftright(c, _WORD_BITS), lambda c: F.col(c).bitwiseAND((1 << _WORD_BITS) - 1).cast("int")
    prints = known.select("doc", F.explode("prints").alias("p")).select("p.print", (spot + F.col("p.at")).alias("spot"))
    lone = prints.groupBy("print").agg(F.min("spot").alias("least"), F.max("spot").alias("most")).where("least = most")
    alone = lone.select(doc_of("least").alias("doc"), word_of("least").alias("at")).groupBy("doc").agg(F.collect_list("at").alias("alone"))
    some = known.where(F.size("prints") > 0).select(F.col("id").alias("id2"), F.col("text_key").alias("key2"), "doc", F.size("prints").alias("n")).distinct()
    some = some.join(alone, "doc", "left").where("alone is null or size(alone) < n")
    # a run has a letter or more in each of its words and a space between them; shorter texts need not travel
    long = base.where(F.length("text") >= 2 * run_words - 1).select("id", "text_key", "text")
    long = long.mapInArrow(_packed, T.StructType([long.schema["id"], long.schema["text_key"], T.StructField("packed", T.BinaryType())]))
    texts = long.join(some, same(long, some)).select("doc", "packed", "alone")
    window = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("content", T.LongType())])
    kind = T.StructType([T.StructField("doc", T.LongType()), T.StructField("windows", T.ArrayType(window))])
    windows = stash(texts.mapInArrow(_shared_windows(run_words, gram_words), kind), "shared-windows")
    each = windows.select("doc", F.explode("windows").alias("w")).select("w.content", (spot + F.col("w.start")).alias("place"))
    origin = each.groupBy("content").agg(F.min("place").alias("place"))
    origins = origin.select(doc_of("place").alias("doc"), word_of("place").alias("start")).groupBy("doc").agg(F.collect_list("start").alias("origins"))
    both = windows.select("doc", F.col("windows.start").alias("starts")).join(origins, "doc", "left")
    spans = both.mapInArrow(_later_spans(run_words), T.StructType([T.StructField("doc", T.LongType()), T.StructField("spans", SPANS)])).dropDuplicates(["doc"])
    out = known.drop("prints").join(spans, "doc", "left")
    return out.select(F.col("id").alias(id_col), "text_key", "n_lines", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def without_spans(text: str, spans: list) -> str:
    """A text without the given word ranges; a line whose words all go takes its line feed along."""
    words = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for r in spans:
        a, b = words[r["first"]][0], words[r["last"]][1]
        before = words[r["first"] - 1][1] if r["first"] else 0
        after = words[r["last"] + 1][0] if r["last"] + 1 < len(words) else len(text)
        opens = text.rfind("\n", before, a) + 1
        feed = text.find("\n", b, after)
        if feed < 0:  # words of the last line follow, or nothing
            b = after
        elif opens or not before:
            a, b = max(opens, done), feed + 1
        else:
            a = before
        out.append(text[done:a])
        done = b
    return "".join(out) + text[done:]


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """The documents with the words of ``repeated_spans`` taken out of their texts; all columns are kept."""
    found = repeated_spans(docs, id_col, text_col, **sizes).select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).where(F.size("__spans") > 0).distinct()
    rows = docs.withColumn("__text_key", _text_key(text_col))
    joined = rows.join(found, rows[id_col].eqNullSafe(found["__id"]) & (F.col("__text_key") == F.col("__key")), "left")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t, s) for t, s in zip(texts, spans)], dtype=object)

    return joined.withColumn(text_col, cut(F.col(text_col).cast("string"), "__spans")).select(*docs.columns)
