"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained on the driver by backpropagation through time, in numpy, on a bounded sample of
labelled windows: at most ``per_lang`` documents a language, those with the least hash of their id. It then
reads every byte of every text, in windows, labels each position, and pools the positions' probabilities
into the document's. Prediction is a map without shuffle; the parameters are a few thousand numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from reckon.llm.common import map_texts

HIDDEN = 8
WINDOW = 96
PER_LANG = 500
STEPS = 500
BATCH = 64
#: Windows that a prediction reads side by side.
ABREAST = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Model:
    """inputs [2, 256, 3H] and recur [2, H, 3H] of both directions (gates z, r, then the candidate); out [2H, K]."""

    langs: list[str]
    inputs: np.ndarray
    recur: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Model:
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(langs, small(2, 256, 3 * hidden), small(2, hidden, 3 * hidden), small(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))

    def states(self, windows: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Hidden states [T, N, 2H] of byte windows [T, N]; ``tape`` gets what the way back needs."""
        steps, n = windows.shape
        h_size = self.recur.shape[1]
        states = np.empty((steps, n, 2 * h_size), np.float32)
        h = np.zeros((2, n, h_size), np.float32)
        gates = np.empty((2, n, 3 * h_size), np.float32)
        for t in range(steps):
            np.take(self.inputs[0], windows[t], axis=0, out=gates[0])
            np.take(self.inputs[1], windows[steps - 1 - t], axis=0, out=gates[1])
            past = np.matmul(h, self.recur)
            zr = _sigmoid(gates[:, :, : 2 * h_size] + past[:, :, : 2 * h_size])
            z, r = zr[:, :, :h_size], zr[:, :, h_size:]
            c = np.tanh(gates[:, :, 2 * h_size :] + r * past[:, :, 2 * h_size :])
            if tape is not None:
                tape.append((h, z, r, c, past[:, :, 2 * h_size :]))
            h = c + z * (h - c)
            states[t, :, :h_size] = h[0]
            states[steps - 1 - t, :, h_size:] = h[1]
        return states

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities [T, N, K] of every position."""
        logits = self.states(windows) @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits


def gradients(model: Model, windows: np.ndarray, valid: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the valid positions, and its gradient by backpropagation through time."""
    tape: list = []
    steps, n = windows.shape
    size = model.recur.shape[1]
    states = model.states(windows, tape)
    logits = states @ model.out + model.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    total = max(1, int(valid.sum()))
    loss = float(-(np.log(p[:, np.arange(n), label] + 1e-9) * valid).sum() / total)
    d = p
    d[:, np.arange(n), label] -= 1
    d *= valid[:, :, None] / np.float32(total)
    d_out = np.einsum("tnh,tnk->hk", states, d, optimize=True)
    d_bias = d.sum(axis=(0, 1))
    d_states = d @ model.out.T
    d_inputs, d_recur = np.zeros_like(model.inputs), np.zeros_like(model.recur)
    carry = np.zeros((2, n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, past_c = tape[t]
        d_h = carry + np.stack([d_states[t, :, :size], d_states[steps - 1 - t, :, size:]])
        d_c = d_h * (1 - z) * (1 - c * c)
        d_z = d_h * (h - c) * z * (1 - z)
        d_r = d_c * past_c * r * (1 - r)
        d_past = np.concatenate([d_z, d_r, d_c * r], axis=2)
        d_gates = np.concatenate([d_z, d_r, d_c], axis=2)
        d_recur += np.matmul(h.transpose(0, 2, 1), d_past)
        np.add.at(d_inputs[0], windows[t], d_gates[0])
        np.add.at(d_inputs[1], windows[steps - 1 - t], d_gates[1])
        carry = d_h * z + np.matmul(d_past, model.recur.transpose(0, 2, 1))
    return loss, [d_inputs, d_recur, d_out, d_bias]


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, window: int = WINDOW, steps: int = STEPS, seed: int = 7) -> Model | None:
    """A network fitted to labelled windows; None without labels. The same rows in the same order give the same model."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    model = Model.fresh(langs, hidden, rng)
    windows, valid = pack([t[:window] for t in texts], window)
    label = np.searchsorted(np.array(langs), np.array(labels))
    of_lang = [np.flatnonzero(label == k) for k in range(len(langs))]
    params = [model.inputs, model.recur, model.out, model.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of_lang[k]) for k in rng.integers(0, len(langs), BATCH)])
        _, grads = gradients(model, windows[:, pick], valid[:, pick], label[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for p, g, m, v in zip(params, grads, first, second):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def pack(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows [T, N], padded by zeros, and which positions are real."""
    windows = np.zeros((len(pieces), window), np.uint8)
    for i, piece in enumerate(pieces):
        windows[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    size = np.array([len(p) for p in pieces])
    return np.ascontiguousarray(windows.T), np.ascontiguousarray((np.arange(window)[:, None] < size[None]))


_ASCII_LETTER = np.zeros(256, np.int64)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = 1


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(model: Model, data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Pooled probabilities [docs, K], and the share of positions that carry each label."""
    size = np.diff(offsets)
    n_windows = -(-size // window)
    doc = np.repeat(np.arange(len(size)), n_windows)
    begin = offsets[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * window
    length = np.minimum(offsets[1:][doc] - begin, window)
    k = len(model.langs)
    pooled, voted = np.zeros((len(size), k)), np.zeros((len(size), k))
    padded = np.concatenate([data, np.zeros(window, np.uint8)])
    for i in range(0, len(doc), ABREAST):
        part = slice(i, i + ABREAST)
        at = np.arange(window)[:, None]
        valid = at < length[part][None]
        windows = np.where(valid, padded[begin[part][None] + at], np.uint8(0))
        p = model.probabilities(windows)
        best = p.argmax(axis=2)
        p *= valid[:, :, None]
        np.add.at(pooled, doc[part], p.sum(axis=0))
        np.add.at(voted, doc[part], np.stack([((best == j) & valid).sum(axis=0) for j in range(k)], axis=1))
    whole = np.maximum(size, 1)[:, None]
    return pooled / whole, voted / whole


def sample(docs: DataFrame, allowed, id_col: str, text_col: str, lang_col: str, per_lang: int, window: int) -> list:
    """At most ``per_lang`` labelled windows a language, from a hashed place in documents of least hash of id and text.

    Hashes are even, so the least of them lie below a threshold that the language's number of distinct hashes
    gives (four times what is wanted). Only rows below it are ranked, each hash once, whatever the number of
    rows, repeats and partitions; equal and null ids do no harm, as texts are hashed too.
    """
    spot = F.xxhash64(F.col(id_col), F.col(text_col), F.lit("spot"))
    at = F.pmod(spot, F.greatest(F.length(text_col) - F.lit(window), F.lit(1)).cast("long")) + 1
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.substring(F.col(text_col), at.cast("int"), F.lit(window)).alias("piece"))
    share = rows.groupBy("lang").agg((F.lit(4.0 * per_lang) / F.approx_count_distinct("h", 0.02)).alias("share"))
    place = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    rows = rows.join(F.broadcast(share), "lang").where((place <= F.col("share")) | (F.col("share") >= 0.5))
    once = rows.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return once.withColumn("rank", rank).where(F.col("rank") <= per_lang).orderBy("lang", "rank").collect()


def fit(docs: DataFrame, allowed, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, steps: int = STEPS) -> Model | None:
    """Train on the rows for which ``allowed`` holds; rows without text or language teach nothing."""
    got = sample(docs, allowed, id_col, text_col, lang_col, per_lang, WINDOW)
    return train([r.piece.encode("utf-8", "replace") for r in got], [r.lang for r in got], steps=steps)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred``, ``score`` (its pooled probability) and ``position_share`` (positions labelled so).

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there is no
    model. Equal texts get equal values; columns of these names give way; empty tables give no rows.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("position_share", T.DoubleType())]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        net = sent.value

        def f(data: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> list[pa.Array]:
            n = len(offsets) - 1
            known = has_letter(data, offsets) & ~null & (net is not None)
            lang, score, share = np.full(n, "und", object), np.zeros(n), np.zeros(n)
            if known.any():
                pooled, voted = predict(net, data, offsets)
                best = pooled.argmax(axis=1)
                lang[known] = np.array(net.langs, object)[best[known]]
                score[known] = np.clip(pooled[np.arange(n), best][known], 0, 1)
                share[known] = voted[np.arange(n), best][known]
            return [pa.array(lang, pa.string()), pa.array(np.round(score, 6)), pa.array(np.round(share, 6))]

        return f

    return map_texts(docs, fields, make, text=text_col, keep=keep, slice_bytes=1 << 20)
