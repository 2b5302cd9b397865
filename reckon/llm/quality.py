"""A quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Features of a text are sparse: the shares of its hashed words, and standardised statistics of its form.
The score needs one pass over them, since the pairwise interactions of rank k sum to
1/2 * sum_f ((sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2). The machine is trained on the driver, in numpy, on
at most ``sample_rows`` labelled rows, those with the least hash of their id; scoring is a map without
shuffle over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reckon.llm.common import NONSPACE, find_words, hash_words, map_texts

WORD_BITS = 13
RANK = 6
SAMPLE_ROWS = 4000
EPOCHS = 6

#: Statistics of a text's form, in the order of ``statistics``.
STATS = (
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "stop", "comma", "mark", "symbol", "bar", "beyond_ascii",
    "line", "distinct_words", "top_word", "same_as_last", "stop_per_word", "symbol_per_word", "capital_words",
)
_CLASSES = ("upper", "lower", "digit", "stop", "comma", "mark", "symbol", "bar", "beyond_ascii", "line")
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _name, _chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("stop", b".?"), ("comma", b",;:"), ("mark", b"!"), ("symbol", b"*#%&$@~^=+<>{}[]\\_/"), ("bar", b"|"), ("beyond_ascii", range(128, 256)), ("line", b"\n")):
    _CLASS_OF[list(_chars), _CLASSES.index(_name)] = 1


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the statistics [n, STATS], and its hashed words as (text, bucket, share)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    shares = np.zeros((n, len(_CLASSES)))
    for i in range(n):
        if size[i]:
            shares[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) @ _CLASS_OF
    starts, ends, first = find_words(data, offsets, NONSPACE)
    hashes = hash_words(data, starts, ends)
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    capital = (data[starts] >= 65) & (data[starts] < 91) if len(starts) else np.zeros(0, bool)
    # one entry for each (text, word): 40 bits of the hash are enough to tell words of one text apart
    key = (text.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    of = (key[at] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    per_byte = shares / np.maximum(size, 1)[:, None]
    stats = np.column_stack(
        [
            np.log1p(size), np.log1p(words), (np.bincount(text, ends - starts, n) if len(text) else np.zeros(n)) / some, per_byte,
            np.bincount(of, minlength=n) / some, top / some, np.bincount(text, again, n) / some,
            shares[:, _CLASSES.index("stop")] / some, shares[:, _CLASSES.index("symbol")] / some, np.bincount(text, capital, n) / some,
        ]
    )
    bucket = ((key[at] & np.uint64((1 << 40) - 1)) >> np.uint64(40 - WORD_BITS)).astype(np.int64)
    both = of * (1 << WORD_BITS) + bucket
    merged, back = np.unique(both, return_inverse=True)
    share = np.bincount(back, count, len(merged)) / some[merged >> WORD_BITS]
    return stats, merged >> WORD_BITS, merged & ((1 << WORD_BITS) - 1), np.sqrt(share)


@dataclass
class Machine:
    """bias, weights [D] and factors [D, k]; the last features are the statistics, standardised by centre and scale."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def score(self, stats: np.ndarray, text: np.ndarray, bucket: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text, in time linear in its features."""
        n = len(stats)
        form = standard(stats, self.centre, self.scale)
        d = len(self.weights) - form.shape[1]
        w, v = self.weights[d:], self.factors[d:]
        linear = self.bias + form @ w + np.bincount(text, self.weights[bucket] * share, n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[bucket, f] * share
            total = form @ v[:, f] + np.bincount(text, vx, n)
            square = (form * form) @ (v[:, f] ** 2) + np.bincount(text, vx * vx, n)
            pairs += total * total - square
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * pairs, -30, 30)))


def standard(stats: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Statistics about zero, in units of their spread, bounded so that no pair of them can run away."""
    return np.clip((stats - centre) / scale, -4, 4) * 0.5


def train(stats: np.ndarray, text: np.ndarray, bucket: np.ndarray, share: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, seed: int = 11) -> Machine:
    """Fit by Adam on the logistic loss. Texts are numbered 0..n-1 and the sparse rows sorted by text."""
    rng = np.random.default_rng(seed)
    n, n_stats = stats.shape
    centre, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    form = standard(stats, centre, scale)
    words = 1 << WORD_BITS
    d = words + n_stats
    prior = (label.sum() + 1) / (n + 2)
    params = [np.array([np.log(prior / (1 - prior))]), np.zeros(d), rng.standard_normal((d, rank)) * 0.02]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    begin = np.searchsorted(text, np.arange(n + 1))
    step, batch = 0, 64
    total_steps = epochs * -(-n // batch)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            m = len(rows)
            size = begin[rows + 1] - begin[rows]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[rows], size)
            of = np.repeat(np.arange(m), size)
            j = np.concatenate([bucket[at], np.tile(np.arange(words, d), m)])
            x = np.concatenate([share[at], form[rows].ravel()])
            of = np.concatenate([of, np.repeat(np.arange(m), n_stats)])
            bias, w, v = params
            vx = v[j] * x[:, None]
            sums = np.stack([np.bincount(of, vx[:, f], m) for f in range(rank)], axis=1)
            squares = np.bincount(of, (vx * vx).sum(axis=1), m)
            y = bias[0] + np.bincount(of, w[j] * x, m) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[rows]) / m
            ex = error[of] * x
            g_v = ex[:, None] * (sums[of] - vx)
            grads = [
                np.array([error.sum()]),
                np.bincount(j, ex, d) + 1e-5 * w,
                np.stack([np.bincount(j, g_v[:, f], d) for f in range(rank)], axis=1) + 1e-5 * v,
            ]
            step += 1
            rate = 0.02 * (1 - step / (total_steps + 1))
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2], centre, scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts and labels of at most ``sample_rows`` labelled ids, those of least hash, one row an id; nulls teach nothing.

    Of several rows of an id the text of least hash teaches; each task keeps one before any text is shuffled.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t")
    return texts.join(F.broadcast(known), "id").groupBy("id", "label").agg(first).select("id", "label", "t.text")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, **columns) -> Machine | None:
    """Train on a bounded sample; None where no row is labelled. The same rows give the same machine."""
    rows = labelled_sample(docs, labels, allowed, **columns)
    fields = [T.StructField("stats", T.ArrayType(T.DoubleType())), T.StructField("bucket", T.ArrayType(T.IntegerType())), T.StructField("share", T.ArrayType(T.FloatType()))]

    def make():
        def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
            stats, text, bucket, share = statistics(data, offsets)
            at = pa.array(np.searchsorted(text, np.arange(len(offsets))), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(at, pa.array(share, pa.float32()))]
            return [pa.array(stats.tolist(), pa.list_(pa.float64())), *lists]

        return f

    got = map_texts(rows, fields, make, keep=["id", "label"]).toPandas()
    if got.empty:
        return None
    got = got.sort_values(["id", "label"], kind="stable", ignore_index=True)
    size = got["bucket"].map(len).to_numpy()
    stats = np.array(got["stats"].tolist(), float)
    bucket = np.concatenate(got["bucket"].tolist()).astype(np.int64)
    share = np.concatenate(got["share"].tolist()).astype(float)
    return train(stats, np.repeat(np.arange(len(got)), size), bucket, share, got["label"].to_numpy(float))


def add_score(docs: DataFrame, machine: Machine | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``score``, the probability that the whole text is of good quality.

    Null texts score as empty ones, which have the statistics of no words; without a machine every score is
    0.5. Equal texts score alike; a carried column ``score`` gives way; empty tables give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        fitted = sent.value

        def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
            if fitted is None:
                return [pa.array(np.full(len(null), 0.5))]
            return [pa.array(np.round(fitted.score(*statistics(data, offsets)), 6))]

        return f

    return map_texts(docs, [T.StructField("score", T.DoubleType())], make, text=text_col, keep=keep, slice_bytes=1 << 20)
