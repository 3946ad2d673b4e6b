"""Operator 11: a Merkle manifest of a table, with proofs by octopus multiproofs.

A row's *leaf* is the SHA-256 of its fields. The leaves of one tree (a language)
stand in the order of doc_id; while a level has several nodes, every ``FAN``
consecutive ones become the digest of theirs, and the subroots of all trees, in the
order of their keys, make up one more tree in the same way, whose root stands for
the table.

Positions come from one range partitioning over (tree, doc_id, leaf): a row's place
is the number of rows in the partitions before its own, which is a sum over one row
per partition and tree, plus its place inside. A tree is built ``STEP`` levels a
round from blocks of ``FAN ** STEP`` consecutive nodes, so that the largest group is
one block, however much of the table a tree holds.

A *proof* of a leaf is the list of its siblings, level by level. The rows to be
proved are dealt by the same blocks. Each such leaf partition first works out, from
positions alone, the minimal union of the node coordinates that its rows' proofs
need and that can't be derived from leaves it holds (octopus). All partitions'
coordinates are fetched with one join against the stored nodes. The partition then
derives the shared interior nodes once and expands every row's own proof locally.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

FAN = 8
#: Levels built in one round; a block holds FAN ** STEP nodes.
STEP = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree of subroots. Names of the others begin with n (null) or s.
TOP = "t"


def _hex(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def _field(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%b" % (len(value), value)


def _leaves(batches):
    for batch in batches:
        leaf, changed = [], []
        for row in zip(*batch.columns):
            doc_id, source, lang, n_chars, text = (v.as_py() for v in row)
            front = b"".join(map(_field, (doc_id, source, lang, n_chars)))
            leaf.append(_hex(front + _field(text)))
            tampered = doc_id is not None and text is not None and zlib.crc32(doc_id) % 3 == 0
            changed.append(_hex(front + _field(text.lower())) if tampered else leaf[-1])  # bytes.lower() changes A-Z only
        arrays = [batch.column("doc_id"), batch.column("lang"), pa.array(leaf, pa.binary()), pa.array(changed, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "leaf", "changed"])


def leaves(docs: DataFrame) -> DataFrame:
    """Rows (tree, doc_id, leaf, changed), one per row of ``docs``; the texts are read here and nowhere else.

    Fields are taken as their UTF-8 bytes (integers as decimals), a text that isn't
    valid UTF-8 as the bytes it has. ``changed`` is the leaf of the tampered row.
    """
    raw = docs.select(*(F.col(c).cast("string").cast("binary").alias(c) for c in FIELDS))
    made = raw.mapInArrow(_leaves, "doc_id binary, lang binary, leaf binary, changed binary")
    lang = F.col("lang").cast("string")
    tree = F.when(lang.isNull(), "n").otherwise(F.concat(F.lit("s"), lang))
    return made.select(tree.alias("tree"), F.col("doc_id").cast("string").cast("long").alias("doc_id"), F.col("leaf").cast("string").alias("leaf"), F.col("changed").cast("string").alias("changed"))


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Add ``pos``, the place from 0 among the rows of the same ``by`` in the order of ``order``, nulls first.

    Equal rows may swap places. One key may hold nearly all rows, or all rows may be
    equal: a last column deals equal rows to several partitions.
    """
    spread = rows.withColumn("__tie", F.monotonically_increasing_id())
    place = F.monotonically_increasing_id()
    ranged = save(spread.repartitionByRange(by, *order, "__tie").sortWithinPartitions(by, *order, "__tie").drop("__tie").withColumn("__at", place), "op11-ranged")
    part = F.shiftrightunsigned("__at", 33).cast("int")
    inside = F.col("__at").bitwiseAND((1 << 33) - 1)
    # One row per partition and key: the widest window has as many rows as there are partitions.
    counts = ranged.groupBy(by, part.alias("__part")).agg(F.count("*").alias("__n"), F.min(inside).alias("__first"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__part")) - F.col("__n"))
    return ranged.withColumn("__part", part).join(counts, [by, "__part"]).withColumn("pos", F.col("__before") + inside - F.col("__first")).drop("__part", "__first", "__before", "__at", "__n")


def _runs(known: dict[int, bytes]) -> dict[int, list[bytes]]:
    """The children of every parent, in order."""
    out: dict[int, list[bytes]] = {}
    for p in sorted(known):
        out.setdefault(p // FAN, []).append(known[p])
    return out


def _sizes(n: int) -> list[int]:
    """Nodes by level, up to the single one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def _built(frame: pd.DataFrame, step: int) -> pd.DataFrame:
    """The next ``step`` levels above one block."""
    tree, level, n = frame["tree"].iat[0], int(frame["level"].iat[0]), int(frame["n"].iat[0])
    known = dict(zip(frame["pos"].tolist(), (h.encode() for h in frame["hash"])))
    rows = []
    for up in range(level + 1, min(level + step, len(_sizes(n)) + level - 1) + 1):
        known = {p: _hex(b"".join(run)) for p, run in _runs(known).items()}
        rows += [(tree, up, p, h.decode()) for p, h in known.items()]
    return pd.DataFrame(rows, columns=["tree", "level", "pos", "hash"])


_NODE = "tree string, level int, pos long, hash string"


def interior(bottom: DataFrame, sizes: DataFrame, step: int = STEP) -> DataFrame:
    """Rows (tree, level, pos, hash) of all nodes above those of ``bottom`` (tree, pos, hash); ``sizes`` has n by tree."""
    spark = bottom.sparkSession
    most = sizes.agg(F.max("n")).first()[0] or 0
    parts, at, now, block = [], 0, bottom.join(sizes, "tree"), FAN**step
    while most > 1:
        dealt = now.where("n > 1").withColumns({"level": F.lit(at), "block": F.floor(F.col("pos") / block)})
        built = dealt.groupBy("tree", "block").applyInPandas(lambda frame: _built(frame, step), _NODE)
        parts.append(save(built, f"op11-nodes{at}"))
        at, most = at + step, -(-most // block)
        less = F.ceil(F.col("n") / block).cast("long")
        now = parts[-1].where(F.col("level") == at).drop("level").join(sizes.select("tree", less.alias("n")), "tree")
        sizes = sizes.withColumn("n", less)
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _NODE)


def missing(positions: list[int], n: int) -> list[tuple[int, int]]:
    """The (level, pos) of the nodes that proofs of the leaves at ``positions`` need and can't derive, of a tree of n leaves."""
    out, have = [], sorted(set(positions))
    for level, size in enumerate(_sizes(n)[:-1]):
        held, parents = set(have), sorted({p // FAN for p in have})
        for q in parents:
            out += [(level, p) for p in range(q * FAN, min(q * FAN + FAN, size)) if p not in held]
        have = parents
    return out


def _asked(frame: pd.DataFrame) -> pd.DataFrame:
    tree, block = frame["tree"].iat[0], frame["block"].iat[0]
    rows = [(tree, block, tree, *at) for at in missing(frame["pos"].tolist(), int(frame["n"].iat[0]))]
    rows += [(tree, block, TOP, *at) for at in missing([int(frame["rank"].iat[0])], int(frame["trees"].iat[0]))]
    return pd.DataFrame(rows, columns=["of", "block", "tree", "level", "pos"])


def _fold(known: dict[int, bytes], sizes: list[int], fetched: dict[tuple[int, int], bytes]) -> list[dict[int, list[bytes]]]:
    """The runs of every level above ``known``: derived nodes and fetched ones, each derived node once."""
    levels = []
    for level, _ in enumerate(sizes[:-1]):
        mine = {p // FAN for p in known}
        runs = _runs(known | {p: h for (at, p), h in fetched.items() if at == level and p // FAN in mine})
        levels.append(runs)
        known = {q: _hex(b"".join(run)) for q, run in runs.items()}
    return levels


def _expanded(key, rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Every row's proof, and the root that its own leaf leads to."""
    n, rank, trees = (int(rows[c].iat[0]) for c in ("n", "rank", "trees"))
    got: dict[bool, dict] = {True: {}, False: {}}
    for tree, level, pos, value in zip(nodes["tree"], nodes["level"], nodes["pos"], nodes["hash"]):
        got[tree == TOP][int(level), int(pos)] = value.encode()
    own = dict(zip(rows["pos"].tolist(), (x.encode() for x in rows["leaf"])))
    levels = _fold(own, _sizes(n), got[False])
    top = len(levels)  # here a path leaves its tree and enters that of the subroots, at its rank
    subroot = _hex(b"".join(levels[-1][0])) if levels else own[0]
    levels += _fold({rank: subroot}, _sizes(trees), got[True])
    whole = _hex(b"".join(levels[-1][0])) if levels else subroot

    def siblings(level: int, p: int) -> bytes:
        run, i = levels[level][p // FAN], p % FAN
        return b"".join(run[:i] + run[i + 1 :])

    above: dict[tuple[int, int], bytes] = {}

    def tail(level: int, p: int) -> bytes:
        """The siblings from the node p of a level upwards; what paths share is put together once."""
        if level == len(levels):
            return b""
        if (level, p) not in above:
            at = rank if level == top else p
            above[level, p] = siblings(level, at) + tail(level + 1, at // FAN)
        return above[level, p]

    out = []
    for doc_id, pos, leaf, changed in zip(rows["doc_id"], rows["pos"].tolist(), rows["leaf"], rows["changed"]):
        p = rank if top == 0 else pos
        proof = siblings(0, p) + tail(1, p // FAN) if levels else b""
        root = whole
        if changed != leaf:
            root, p = changed.encode(), pos
            for level, runs in enumerate(levels):
                p = rank if level == top else p
                run, i = runs[p // FAN], p % FAN
                root, p = _hex(b"".join([*run[:i], root, *run[i + 1 :]])), p // FAN
        out.append((key[0], doc_id, leaf, _hex(proof).decode(), root.decode()))
    return pd.DataFrame(out, columns=["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])


class Manifest:
    """The stored Merkle trees of a table: ``leaves`` (tree, doc_id, leaf, changed, pos, n, rank, trees), ``nodes``, ``subroots``, ``root``."""

    def __init__(self, docs: DataFrame, step: int = STEP):
        self.block = FAN**step
        self.leaves = save(numbered(save(leaves(docs), "op11-leaves"), "tree", ["doc_id", "leaf"]), "op11-numbered")
        sizes = save(self.leaves.groupBy("tree").agg(F.count("*").alias("n")), "op11-sizes")
        bottom = self.leaves.select("tree", "pos", F.col("leaf").alias("hash"))
        inner = interior(bottom, sizes, step)
        # A tree's last node; a lone leaf stands for itself.
        high = inner.groupBy("tree").agg(F.max("level").alias("level"))
        last = inner.join(high, ["tree", "level"]).select("tree", "hash").union(bottom.join(sizes.where("n = 1"), "tree", "left_semi").select("tree", "hash"))
        ranked = numbered(save(last, "op11-subroots").withColumn("__all", F.lit(TOP)), "__all", ["tree"]).drop("__all")
        self.subroots = save(ranked.join(sizes, "tree").withColumnRenamed("pos", "rank"), "op11-ranked")
        trees = self.subroots.count()
        upper = save(self.subroots.select(F.lit(TOP).alias("tree"), F.col("rank").alias("pos"), "hash"), "op11-upper")
        count = upper.groupBy("tree").agg(F.count("*").alias("n"))
        above = interior(upper, count, step)
        self.nodes = inner.union(above).union(upper.select("tree", F.lit(0).alias("level"), "pos", "hash"))
        self.trees = trees
        top = (above if trees > 1 else upper.withColumn("level", F.lit(0))).agg(F.max_by("hash", "level")).first()
        self.root = top[0]

    def prove(self, wanted: DataFrame | None = None) -> DataFrame:
        """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the rows whose doc_id ``wanted`` has, or of all.

        proof_sha256 is the digest of the siblings in order; folded_root is what the
        row's leaf (of a tampered row: the changed one) leads to with these siblings.
        """
        info = self.subroots.select("tree", "n", "rank", F.col("hash").alias("subroot"))
        rows = self.leaves if wanted is None else self.leaves.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).join(info.drop("subroot"), "tree").withColumns({"trees": F.lit(self.trees), "block": F.floor(F.col("pos") / self.block)})
        asked = save(rows.select("tree", "block", "pos", "n", "rank", "trees").groupBy("tree", "block").applyInPandas(_asked, "of string, block long, tree string, level int, pos long"), "op11-asked")
        stored = self.nodes
        if wanted is not None:  # all rows of a block hold all of its leaves
            stored = stored.union(self.leaves.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("hash")))
        fetched = asked.join(stored, ["tree", "level", "pos"])
        proofs = rows.groupBy("tree", "block").cogroup(fetched.groupBy("of", "block")).applyInPandas(_expanded, "tree string, doc_id string, leaf string, proof_sha256 string, folded_root string")
        out = proofs.join(info.select("tree", "subroot"), "tree").withColumn("root", F.lit(self.root))
        return out.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def prove_all(docs: DataFrame, wanted: DataFrame | None = None, step: int = STEP) -> DataFrame:
    """The proofs of all rows of ``docs`` (doc_id, source, lang, n_chars, text), or of those that ``wanted`` (doc_id) names.

    A row whose crc32(doc_id) three divides counts as tampered with: its text's A-Z
    are lower-cased after the manifest was made. Null fields are leaves' ``-``; a
    null doc_id comes first in its tree and is never tampered with. Rows of one
    doc_id stand in the order of their leaves. Other columns are ignored, an empty
    table has no rows.
    """
    return Manifest(docs, step).prove(wanted)
