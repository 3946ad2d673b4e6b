"""Operator 4: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes; only the bag has a label.
Every passage is encoded (hashed byte n-gram spectrum and a few ratios, then a
learned tanh layer), gated attention weighs the passages,

    a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) ),

and a logistic unit scores the weighted sum of their representations. The weights
are learned from all passages of a bounded sample of labelled documents: at most
``FIT_DOCS`` of them and ``FIT_BYTES`` of text, none longer than ``FIT_LONGEST``.
Scoring takes every passage of every whole text, and keeps a running softmax, so
that the memory for a very long text stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, save

PASSAGE = 512
SPECTRUM = 1024
HIDDEN = 32
GATE = 16
FIT_DOCS = 4000
FIT_BYTES = 12_000_000
FIT_LONGEST = 1_000_000
STEPS = 600
KEEP = 0.3

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c in "abcdefghijklmnopqrstuvwxyz" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c == " " else 5 if _c == "\n" else 6 if _b > 127 else 0
_RATIOS = 7 + 2


def encode(flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """One vector per passage: root frequencies of hashed 1- to 3-grams of bytes, byte classes, distinct share, size."""
    size = np.maximum(1, np.bincount(row, minlength=n)).astype(np.float32)[:, None]
    grams = np.zeros(n * SPECTRUM, np.float32)
    code = np.zeros(len(flat), np.uint32)
    for k in range(3):
        m = len(flat) - k
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + flat[k:]
        place = ((code + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(22)
        own = row[:m]
        if k:
            same = row[:m] == row[k:]
            own, place = own[same], place[same]
        grams += np.bincount(own * SPECTRUM + place, minlength=n * SPECTRUM)
    grams = grams.reshape(n, SPECTRUM)
    classes = np.bincount(row * 7 + _CLASS[flat], minlength=n * 7).reshape(n, 7) / size
    distinct = (grams > 0).sum(axis=1, keepdims=True) / np.sqrt(3 * size) / 20
    spectrum = np.sqrt(grams / (3 * size))
    return np.concatenate([spectrum, classes, distinct, size / PASSAGE], axis=1).astype(np.float32)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, the passage of each, and the text of each passage; an empty text has one empty passage."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(n) - n
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(first, size) + at // PASSAGE, np.repeat(np.arange(len(texts)), n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The model; plain arrays, so that it travels to the tasks as it is."""

    def __init__(self, width: int, seed: int = 11):
        g = np.random.default_rng(seed)
        draw = lambda *shape: (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": draw(width, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def passages(self, x: np.ndarray):
        h = np.tanh((x - self.mean) / self.scale @ self.p["E"] + self.p["e"])
        t, g = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        return h, t, g, (t * g) @ self.p["w"]

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        """Adam on the logistic loss; ``owner`` is sorted and has every document."""
        p, g = self.p, np.random.default_rng(seed)
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0) + np.float32(1e-2)
        p["b"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        first = np.searchsorted(owner, np.arange(len(y) + 1))
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        for step in range(1, STEPS + 1):
            docs = g.choice(len(y), min(128, len(y)), replace=False)
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            _, grad = self.gradient(x[rows], own, y[docs])
            rate = 0.01 * (1 - 0.9 * step / STEPS)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def gradient(self, x: np.ndarray, own: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean logistic loss (with a penalty on E) of the documents whose passages are ``x``, and its gradient."""
        p, n = self.p, len(y)
        z = (x - self.mean) / self.scale
        h, t, s, e = self.passages(x)
        top = np.full(n, -np.inf, e.dtype)
        np.maximum.at(top, own, e)
        a = np.exp(e - top[own])
        a /= np.bincount(own, a, n)[own]
        bag = np.zeros((n, HIDDEN), h.dtype)
        np.add.at(bag, own, h * a[:, None])
        logit = bag @ p["c"] + p["b"]
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit)) + 0.5e-4 * float((p["E"] ** 2).sum())
        error = ((_sigmoid(logit) - y) / n).astype(h.dtype)
        d_bag = error[:, None] * p["c"]
        d_a = (h * d_bag[own]).sum(axis=1)
        d_e = a * (d_a - np.bincount(own, a * d_a, n)[own])
        d_t, d_s = d_e[:, None] * p["w"] * s * (1 - t * t), d_e[:, None] * p["w"] * t * s * (1 - s)
        d_h = (a[:, None] * d_bag[own] + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        grad = {"E": z.T @ d_h + 1e-4 * p["E"], "e": d_h.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s, "w": ((t * s) * d_e[:, None]).sum(axis=0), "c": bag.T @ error, "b": error.sum(keepdims=True)}
        return loss, grad

    def score(self, texts: list[bytes], most: int = 1_000_000) -> np.ndarray:
        """Scores of whole texts; the running softmax joins the groups a long text is cut into."""
        top = np.full(len(texts), -np.inf)
        weight, bag = np.zeros(len(texts)), np.zeros((len(texts), HIDDEN))
        pieces, own, held = [], [], 0

        def flush():
            flat, row, piece = cut(pieces)
            h, _, _, e = self.passages(encode(flat, row, len(piece)))
            of = np.array(own)[piece]
            high = np.maximum(top, -1e29)
            np.maximum.at(high, of, e)
            shrink = np.exp(np.where(np.isfinite(top), top, -1e30) - high)
            weight[:], bag[:], top[:] = weight * shrink, bag * shrink[:, None], high
            a = np.exp(e - high[of])
            np.add.at(weight, of, a)
            np.add.at(bag, of, h * a[:, None])

        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text)), PASSAGE * 1024):
                pieces.append(text[at : at + PASSAGE * 1024])
                own.append(i)
                held += len(pieces[-1]) + 64
                if held > most:
                    flush()
                    pieces, own, held = [], [], 0
        if pieces:
            flush()
        return _sigmoid(bag / weight[:, None] @ self.p["c"] + self.p["b"])


def learn(docs: DataFrame, labels: DataFrame) -> Attention | None:
    """The model fitted on the labelled documents outside the held-out fifth, the first by hash that keep to the bounds.

    Of several rows with one doc_id the least text counts, so at most FIT_DOCS texts
    of FIT_BYTES in all reach the driver, whatever is repeated.
    """
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    text = F.coalesce("text", F.lit(""))
    once = docs.select("doc_id", text.alias("text")).where(F.octet_length(text) <= FIT_LONGEST).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    once = save(once.withColumn("size", F.octet_length("text").cast("long")), "op4-labelled")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # at most FIT_DOCS rows
    fits = once.select("doc_id", (F.sum("size").over(order) <= FIT_BYTES).alias("fits")).where("fits")
    drawn = sorted(once.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "quality").collect(), key=lambda r: r["doc_id"])
    y = np.array([float(r["quality"] == 1) for r in drawn], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    parts, owners = [], []
    for at in range(0, len(drawn), 64):  # encoded in groups, since the n-gram counts of a group are held at once
        flat, row, owner = cut([r["text"].encode() for r in drawn[at : at + 64]])
        n = np.searchsorted(row, np.arange(len(owner) + 1))
        for first in range(0, len(owner), 1000):
            last = min(first + 1000, len(owner))
            parts.append(encode(flat[n[first] : n[last]], row[n[first] : n[last]] - first, last - first))
        owners.append(owner + at)
    x = np.concatenate(parts)
    model = Attention(x.shape[1])
    model.fit(x, np.concatenate(owners), y)
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``labels`` has doc_id and quality (0 or 1; the greatest counts where a doc_id
    has several). Null text counts as empty; other columns are ignored; equal texts
    get equal scores. Without labels of both values every score is 1: nothing
    speaks against any document.
    """
    model = learn(docs, labels)

    def rows(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            score = model.score(texts) if model and texts else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score.astype(np.float64)), pa.array((score >= KEEP).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return ready.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
