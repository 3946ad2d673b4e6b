"""Operator 7: language identification by string kernels.

The kernel of two texts is the number of byte n-grams, of every length up to
``SPECTRUM``, that both contain (a blended-spectrum presence kernel), divided by
the root of the product of their own numbers. N-grams are hashed to ``WIDTH``
places. Nyström landmarks span the feature space, one-versus-rest kernel ridge
regression is solved in it, and scoring is one matrix product a batch: presence
rows times the landmarks' presence, the landmark transform and the ridge weights,
of which the last three are multiplied beforehand.

A text is cut into passages of ``PASSAGE`` bytes, since presence saturates in long
texts, and all its passages count in proportion to their letters. The fit sees one
passage a document, from a place that its hash says: of long documents a part.
Presence rows are made in groups, so that only a group of them is ever held.

The classifiers only compare languages. Whether a text belongs to the one they
choose is read from its n-grams: the share of the language's passages that hold
one, averaged over the text's n-grams, against a cut for passages of that size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out

SPECTRUM = 4
WIDTH = 4096
PASSAGE = 1000
LANDMARKS = 256
#: The fit's sample: at most so many passages of a language, and of all languages.
PER_LANGUAGE = 300
IN_ALL = 60_000
RIDGE = 1e-3
#: Passages whose presence rows are held at once, by the driver and by a task.
HELD = 1000
#: Passage sizes at which belonging is calibrated, and the pieces of a language that it takes.
SIZES = (8, 16, 32, 64, 128, 256, 512, 1000)
PIECES = 10

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: Everything but letters is white space; bytes beyond ASCII count as letters.
_LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def _normal(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def _presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Presence rows of all passages of ``texts``, the text each belongs to, and its bytes."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = np.maximum(1, -(-size // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(first, size) + at // PASSAGE
    seen = np.zeros((len(owner), WIDTH), np.float32)
    code = np.zeros(len(flat), np.uint32)
    for k in range(SPECTRUM):
        m = len(flat) - k
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + flat[k:]
        whole = row[:m] == row[k:] if k else slice(None)
        place = ((code + np.uint32(k)) * _ODD[k]) >> np.uint32(20)
        seen[row[:m][whole], place[whole]] = 1
    return seen, owner, np.bincount(row, minlength=len(owner))


def _unit(seen: np.ndarray) -> np.ndarray:
    return seen / np.sqrt(np.maximum(1, seen.sum(axis=1, keepdims=True)))


def fit(passages: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The languages and, folded into one matrix, landmarks, Nyström transform and ridge weights."""
    names = sorted(set(langs))
    cut = [p[:PASSAGE] for p in passages]
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    each = max(1, LANDMARKS // len(names))
    marks = np.concatenate([np.flatnonzero(y[:, i] > 0)[:each] for i in range(len(names))])
    base = _unit(np.concatenate([_presence([cut[i] for i in marks[at : at + HELD]])[0] for at in range(0, len(marks), HELD)])).astype(np.float64)
    value, vector = np.linalg.eigh(base @ base.T)
    root = base.T @ (vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6]))
    square, right = np.zeros((root.shape[1], root.shape[1])), np.zeros((root.shape[1], len(names)))
    for at in range(0, len(cut), HELD):
        phi = _unit(_presence(cut[at : at + HELD])[0]) @ root
        square += phi.T @ phi
        right += phi.T @ y[at : at + HELD]
    weights = np.linalg.solve(square + RIDGE * len(cut) * np.eye(root.shape[1]), right)
    return names, (root @ weights).astype(np.float32)


def belonging(passages: list[bytes], langs: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The share of each language's passages that hold an n-gram (WIDTH x languages), and the least mean share that counts as belonging (SIZES x languages).

    Half of the passages give the shares, the others the cuts: halfway between the
    median of the language's own pieces and that of pieces whose language is left
    out (of shuffled ones if it's the only one), but below 99 % of its own. A
    language with too little text for that has the cut 0.
    """
    parts = [[p for p, x in zip(passages, langs, strict=True) if x == name] for name in names]
    grouped = lambda texts: (_presence(texts[at : at + HELD])[0] for at in range(0, len(texts), HELD))
    share = np.stack([sum(r.sum(axis=0, dtype=np.float64) for r in grouped([t[:PASSAGE] for t in p[::2]])) / len(p[::2]) for p in parts], axis=1).astype(np.float32)
    mean = lambda texts: np.concatenate([r @ share / np.maximum(1, r.sum(axis=1, keepdims=True)) for r in grouped(texts)])
    cuts = np.zeros((len(SIZES), len(names)))
    for k, n in enumerate(SIZES):
        own, other = {}, []
        for i, p in enumerate(parts):
            text = b"".join(p[1::2])
            pieces = [text[at : at + n] for at in range(0, len(text) - n + 1, max(n, len(text) // 200))]
            if len(pieces) < PIECES:
                continue
            value = mean(pieces)
            own[i] = value[:, i]
            if len(names) > 1:
                other.append(np.delete(value, i, axis=1).max(axis=1))
            else:
                rng = np.random.default_rng(7)
                other.append(mean([rng.permutation(np.frombuffer(t, np.uint8)).tobytes() for t in pieces])[:, 0])
        for i, value in own.items():
            cuts[k, i] = min((np.median(value) + np.median(np.concatenate(other))) / 2, np.quantile(value, 0.01))
    return share.astype(np.float32), cuts


def sample(docs: DataFrame) -> list:
    """At most PER_LANGUAGE passages of each language (fewer if languages are very many), chosen by hash."""
    known = docs.select(F.col("doc_id"), "lang", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text")).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    counts = known.groupBy("lang").count()
    most = max(2, min(PER_LANGUAGE, IN_ALL // max(1, counts.count())))
    order = F.xxhash64("doc_id", "text")
    share = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.shiftrightunsigned(order, 7), F.greatest(F.length("text") - PASSAGE, F.lit(1))).cast("int") + 1
    # Twice the wanted share, and all where there are few; each task keeps the first ``most`` of a language before the shuffle.
    drawn = known.join(F.broadcast(counts) if counts.count() <= 100_000 else counts, "lang").where(share * F.col("count") < 2.0 * most)
    passages = drawn.select("lang", order.alias("o"), F.substring("text", start, F.lit(PASSAGE)).alias("passage")).distinct()
    first = Window.partitionBy("lang").orderBy("o", "passage")
    rows = passages.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most).collect()
    return sorted(rows, key=lambda r: (r["o"], r["lang"], r["passage"]))


def score(docs: DataFrame, names: list[str], matrix: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with __lang and __score, for all rows and whole texts; __near says by how much a text belongs (0 or more: it does), 0 without ``known``."""
    place = docs.columns.index("text")
    schema = docs.select("*", F.lit("").alias("__lang"), F.lit(0.0).alias("__score"), F.lit(0.0).alias("__near")).schema

    def rows(batches):
        for batch in batches:
            texts = [None if t is None else t.decode(errors="replace") for t in batch.column(place).cast(pa.binary()).to_pylist()]
            pred, sure, near = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t)) and names]
            total, over = np.zeros((len(texts), len(names))), np.zeros((len(texts), len(names)))
            weight = np.zeros(len(texts))
            for piece, own in _pieces(texts, todo):
                seen, owner, size = _presence(piece)
                value = _unit(seen) @ matrix
                np.add.at(total, own[owner], value * size[:, None])
                np.add.at(weight, own[owner], size)
                if known is not None:
                    share, cuts = known
                    held = seen @ share / np.maximum(1, seen.sum(axis=1, keepdims=True))
                    least = np.stack([np.interp(np.log2(np.maximum(1, size)), np.log2(SIZES), cuts[:, i]) for i in range(len(names))], axis=1)
                    np.add.at(over, own[owner], (held - least) * size[:, None])
            mean = total / np.maximum(1, weight)[:, None]
            for i in todo:
                best = int(mean[i].argmax())
                pred[i], sure[i], near[i] = names[best], float(np.clip((1 + mean[i].max()) / 2, 0, 1)), float(over[i, best] / max(1, weight[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(near, pa.float64())], names=[*batch.schema.names, "__lang", "__score", "__near"])

    return docs.mapInArrow(rows, schema)


def _pieces(texts: list[str], todo: list[int], most: int = HELD * PASSAGE // 2):
    """The normal forms of texts in groups of about ``most`` bytes and at most HELD passages, longer ones in several, with the index of each."""
    piece, own, held = [], [], 0
    for i in todo:
        t = _normal(texts[i])
        for at in range(0, len(t), most):
            piece.append(t[at : at + most])
            own.append(i)
            held += max(PASSAGE // 2, len(piece[-1]))  # so that there are no more than HELD, however short
            if held >= most:
                yield piece, np.array(own)
                piece, own, held = [], [], 0
    if piece:
        yield piece, np.array(own)


def learn(docs: DataFrame, belongs: bool = True) -> tuple[list[str], np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """What ``fit`` and, if asked for, ``belonging`` give."""
    known = sample(docs)
    if not known:
        return [], np.zeros((WIDTH, 0), np.float32), (np.zeros((WIDTH, 0), np.float32), np.zeros((len(SIZES), 0)))
    passages, langs = [_normal(r["passage"]) for r in known], [r["lang"] for r in known]
    names, matrix = fit(passages, langs)
    return names, matrix, belonging(passages, langs, names) if belongs else None


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    lang and doc_id serve only to choose what is learned from; null or letterless
    texts, and all texts where no language can be learned, are ``und`` with score
    0. Bytes that aren't UTF-8 are read as U+FFFD. Other columns are ignored; equal texts get equal predictions; an empty
    table has no rows.
    """
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(ready, *learn(docs, False)[:2]).select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und``, and belonging to the language chosen.

    With no labelled row at all, every row is ``und`` and goes.
    """
    return score(docs, *learn(docs)).where((F.col("__lang") != "und") & (F.col("__near") >= 0)).drop("__lang", "__score", "__near")
