"""Operator 9: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 r`` bits have a common variant within
``r`` bits of each. Every distinct fingerprint therefore emits all its variants
of radius ``r = 2``; variants that coincide join their fingerprints, and each
colliding pair is verified.

The shuffle key of a variant is its value in a few of the 64 bits (those that
split the fingerprints most evenly; as many as keep a group's variants near
``VARIANTS``). A fingerprint travels once to each group that any of its variants
falls into, and the group spells those variants out, so the shuffle holds tens
of rows a fingerprint rather than 2081. Groups are counted before they are sent: one
of more than ``GROUP`` fingerprints (a large family of near copies agrees on nearly
all bits) is split by the bits in which its own members differ most, until each fits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .components import connected_components

RADIUS = 2
#: Variants that a task holds at once, and bits that it spells out at once.
VARIANTS = 500_000
SPELL_BITS = 8
#: Fingerprints of one group, and bits by which a larger one is split at once.
GROUP = 20_000
SPLIT_BITS = 4


def _fingerprint(text: bytes, size: int) -> int:
    flat = b" ".join(text.lower().split())
    if not flat:
        return 0
    ends = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate([[0], ends + 1])
    ends = np.append(ends, len(flat))
    if len(starts) > size:
        starts, ends = starts[: len(starts) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(flat[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())])
    codes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(codes), 65536):
        ones += np.unpackbits(codes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(codes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """Rows (doc_id, dk, fp): the SimHash of each row's whole text; dk is a key of the row's content.

    Null and blank texts have fingerprint zero. Texts of fewer than ``size`` words
    have one shingle, the whole sequence.
    """

    def rows(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            found = pa.array([_fingerprint(t or b"", size) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "dk", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("dk"), "text")
    return keyed.mapInArrow(rows, "doc_id long, dk long, fp long")


def _flips(bits: list[int]) -> tuple[np.ndarray, ...]:
    """The masks of at most 0, 1 and 2 flips among ``bits``."""
    one = np.uint64(1) << np.array(bits, np.uint64)
    a, b = np.triu_indices(len(bits), 1)
    none = np.zeros(1, np.uint64)
    return none, np.concatenate([none, one]), np.concatenate([none, one, one[a] ^ one[b]])


def _shared(current: np.ndarray, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose value in the bits ``fixed`` another row has too, in order of that value, and where each value begins."""
    key = current & np.uint64(fixed)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])
    lone = new & np.append(new[1:], True)
    return order[~lone], np.flatnonzero(new[~lone])


def _collide(current: np.ndarray, left: np.ndarray, origin: np.ndarray, fixed: int, free: list[int], limit: int):
    """Pairs of origins with a common variant: all values that ``current`` reaches with at most ``left`` flips of ``free`` bits.

    Bits are spelled out ``SPELL_BITS`` at a time, of about ``limit`` variants at once;
    those whose value so far no other has are dropped.
    """
    own, starts = _shared(current, fixed)
    if not len(own):
        return
    current, left, origin = current[own], left[own], origin[own]
    if not free:
        same = np.setdiff1d(np.arange(1, len(own)), starts)
        yield origin[same - 1], origin[same]
        return
    bits, rest = free[:SPELL_BITS], free[SPELL_BITS:]
    flips = _flips(bits)
    fixed |= sum(1 << i for i in bits)
    spelled = np.cumsum(np.array([len(f) for f in flips])[left])
    ends = np.append(starts[1:], len(own))
    at = 0
    while at < len(own):
        room = (spelled[at - 1] if at else 0) + limit
        end = int(ends[max(np.searchsorted(ends, np.searchsorted(spelled, room, "right"), "right") - 1, np.searchsorted(ends, at, "right"))])
        parts = []
        for n, mask in enumerate(flips):
            rows = at + np.flatnonzero(left[at:end] == n)
            after = (n - np.bitwise_count(mask)).astype(np.int8)
            parts.append(((current[rows, None] ^ mask).ravel(), np.tile(after, len(rows)), np.repeat(origin[rows], len(mask))))
        yield from _collide(*(np.concatenate(x) for x in zip(*parts)), fixed, rest, limit)
        at = end


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least row of each row's component, given the pairs and the labels so far."""
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(jump := label[label], label):
            label = jump
        if np.array_equal(label[a], label[b]):
            return label


def links(fps: DataFrame, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints ``fps`` (fp) as all pairs within four bits would.

    Of ``blocks`` blocks of bits all but four make a key; by default as few as keep groups
    at a fifth of ``GROUP`` on average (four, so one group, for a small table).
    A group of fingerprints with a common variant gives a tree of links, never all
    its pairs, and every link was verified to differ in at most four bits or to be
    the sum of such links.
    """
    n, even = _even(fps)
    blocks = blocks or next(b for b in range(2 * RADIUS, 65) if n >> 64 * (b - 2 * RADIUS) // b <= GROUP // 5)
    dealt = [sum(1 << i for i in even[k::blocks]) for k in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(dealt, blocks - 2 * RADIUS)]
    sent = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("mask"))
    sent = sent.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    size = sent.groupBy("mask", "value").agg(F.count("*").alias("n")).where((F.col("n") > GROUP) & (F.col("mask") != -1))
    large = save(size.select("mask", "value"), "op9-hot")
    parts: list[DataFrame] = []
    if count := large.count():
        near = F.broadcast if count <= 100_000 else (lambda table: table)
        hot = save(sent.join(near(large), ["mask", "value"], "left_semi").select("fp").distinct(), "op9-family")
        sent = sent.join(near(large), ["mask", "value"], "left_anti")
        parts = [part.withColumn("part", F.col("value")) for part in _split(_balls(hot))]
    # Small groups share a call.
    parts.append(sent.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(max(128, n // GROUP)))))

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        mask = int(frame["mask"].iloc[0]) % (1 << 64)
        current = (fp & ~np.uint64(mask)) | frame["value"].to_numpy(np.int64).view(np.uint64)
        left = (RADIUS - np.bitwise_count(fp ^ current)).astype(np.int8)
        label = np.arange(len(fp))
        for a, b in _collide(current, left, np.arange(len(fp)), mask, [i for i in even if not mask >> i & 1], VARIANTS):
            near = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * RADIUS
            label = _forest(len(fp), a[near], b[near], label)
        own = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[own].view(np.int64), "v": fp[label[own]].view(np.int64)})

    found = [part.groupBy("mask", "part").applyInPandas(group, "u long, v long") for part in parts]
    return reduce(DataFrame.union, found)


def _even(fps: DataFrame) -> tuple[int, list[int]]:
    """The number of ``fps`` (fp), and the 64 bits, those first that split them most evenly."""
    ones = fps.agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{i}") for i in range(64))).first()
    n = ones["n"]
    return n, sorted(range(64), key=lambda i: (abs(2 * (ones[f"b{i}"] or 0) - n), i))


def _balls(fps: DataFrame) -> DataFrame:
    """Rows (fp, mask, value): the values of the variants of ``fps`` (fp) in as many of their most even bits as keep groups below ``GROUP`` on average."""
    n, even = _even(fps)
    depth = next(d for d in range(25) if d == 24 or n * (1 + d + d * (d - 1) // 2) <= GROUP // 2 << d)
    chosen = even[:depth]
    flips = [0] + [1 << i for i in chosen] + [1 << i | 1 << j for k, i in enumerate(chosen) for j in chosen[:k]]
    kept = F.lit(_signed(sum(1 << i for i in chosen))).cast("long")
    sent = fps.select("fp", F.explode(F.array(*(F.lit(_signed(x)).cast("long") for x in flips))).alias("flip"))
    return sent.select("fp", kept.alias("mask"), F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(kept).alias("value"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(sent: DataFrame, most: int | None = None) -> list[DataFrame]:
    """Rows (fp, mask, value) such that no (mask, value) has more than ``most``: large ones take more bits into their mask.

    A row goes on to every value of the new bits that it reaches with the flips that
    value leaves it. Groups whose members agree on all free bits don't exist, since
    fingerprints are distinct.
    """
    most = most or GROUP
    key = ["mask", "value"]
    parts: list[DataFrame] = []
    while True:
        size = sent.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > most) & (F.col("mask") != -1))
        large = save(size.select(*key), "op9-large")
        count = large.count()
        if not count:
            return [*parts, sent]
        near = F.broadcast if count <= 100_000 else (lambda table: table)
        parts.append(sent.join(near(large), key, "left_anti"))
        hot = sent.join(near(large), key, "left_semi")
        # The free bits in which the members differ most; a mask of all bits needs no split.
        ones = hot.groupBy(*key).agg(F.count("*").alias("n"), F.array(*(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1).cast("long"))) for i in range(64))).alias("ones"))
        uneven = F.transform("ones", lambda x, i: F.struct(F.abs(2 * x - F.col("n")).alias("off"), i.alias("bit")))
        free = F.filter(uneven, lambda x: F.call_function("shiftright", F.col("mask"), x["bit"]).bitwiseAND(F.lit(1).cast("long")) == 0)
        one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        bits = ones.select(*key, F.transform(F.slice(F.array_sort(free), 1, SPLIT_BITS), lambda x: one(x["bit"])).alias("bits"))
        hot = hot.join(near(save(bits, "op9-bits")), key)
        none = F.array(F.lit(0).cast("long"))
        pairs = F.flatten(F.transform("bits", lambda a: F.transform(F.filter("bits", lambda b: b > a), lambda b: a.bitwiseOR(b))))
        left = RADIUS - F.bit_count(F.col("fp").bitwiseXOR(F.col("value")).bitwiseAND(F.col("mask")))
        flips = F.when(left >= 2, F.concat(none, "bits", pairs)).when(left == 1, F.concat(none, "bits")).otherwise(none)
        added = F.aggregate("bits", F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(b))
        grown = hot.select("fp", F.col("mask").bitwiseOR(added).alias("mask"), "value", added.alias("added"), F.explode(flips).alias("flip"))
        sent = save(grown.select("fp", "mask", F.col("value").bitwiseOR(F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.col("added"))).alias("value")), "op9-split")


def components(docs: DataFrame, size: int = 4) -> DataFrame:
    """Rows (doc_id, dk, fp, component_id), one per row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over links of four bits or fewer,
    itself included; null only where all doc_ids of the component are null. Copies
    meet as one fingerprint before any pair is looked for. Other columns of
    ``docs`` are ignored; an empty table has no rows.
    """
    own = save(fingerprints(docs, size), "op9-fingerprints")
    distinct = save(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "op9-distinct")
    roots = connected_components(save(links(distinct.select("fp")), "op9-links"), "op9-components")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = save(rooted.join(least, "root").select("fp", "component_id"), "op9-named")
    return own.join(named, "fp").select("doc_id", "dk", "fp", "component_id")


def near_duplicates(docs: DataFrame, size: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint as 16 hexadecimal digits, component_id)."""
    found = components(docs, size)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component its least row stays.

    The least row has the least doc_id (nulls last), then the least content key. Of
    rows that share doc_id and text the one of the least hash of all columns stays
    (of equal rows any), in whatever order they come.
    """
    own = save(components(docs, size), "op9-rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dk")
    anchor = own.withColumn("component", F.coalesce("component_id", "fp")).groupBy("component", F.col("component_id").isNull().alias("unnamed"))
    first = save(anchor.agg(F.min(key).alias("k"), F.count("*").alias("c")).select("k.doc_id", "k.dk"), "op9-first")
    keyed = docs.withColumn("__dk", F.xxhash64("doc_id", "text"))
    mine = first.select(F.col("doc_id").alias("__id"), F.col("dk").alias("__first"))
    kept = keyed.join(mine, (keyed["__dk"] == mine["__first"]) & keyed["doc_id"].eqNullSafe(mine["__id"]), "left_semi")
    if own.groupBy("doc_id", "dk").count().where("count > 1").limit(1).count():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        order = F.struct(F.sha2(F.to_json(row), 256), F.xxhash64(row))
        kept = kept.groupBy("doc_id", "__dk").agg(F.min_by(row, order).alias("__row")).select("__row.*")
    return kept.drop("__dk")
