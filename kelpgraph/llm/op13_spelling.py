"""Operator 13: spelling variants by a relational trie frontier.

All words of the corpus are counted, then every word looks for the words one edit
away by walking a trie that is a distributed table of edges. A state is (word,
position, node, edits). The states without an edit are the nodes of a word's own path.
They are joined with all edges of their nodes, on each of which one code point may be
inserted or replaced; then, level by level, the states with an edit are joined with the
edge that goes on with their next code point. States at a terminal node at the end of
their word are neighbours. A level writes its states as a table, and the walk ends when
none are left. A pair is walked once, from the shorter word, or from the one that has
the lesser code point where they differ, and then told both ways.

* The trie is compressed: chains without a branch are one edge with a longer label, so
  the number of levels is that of branches, not of letters.
* The upper levels of a trie have all letters below every node, and an edit there
  meets all of them. An edit lies in the first or in the last half of a word; so
  there is one trie of the words and one of the words reversed, and a word enters each
  at its half, where few others are left. Only the halves of words are in the edge table.
* A node has a mask of 64 bits, one for the hash of each suffix below it. A state that
  has its edit goes on only where the bit of the rest of its word is set: it needs that
  very suffix. It's a filter before the walk; the walk itself decides.
* A node is known by the hash of its path. Pairs are compared letter by letter at the
  end, so that two paths of one hash cost a comparison and give no false pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant; one in EVERY runs loses a code point.
TIMES, EVERY = 10, 31
#: Letters of the words whose paths a task works out at once.
LETTERS = 200_000
_BASE = 0x5851F42D4C957F2D


def lowered(run) -> F.Column:
    """Lower-case A-Z only. lower() does that much faster, where no other capital is in the run."""
    return F.when(run.rlike(r"[À-Þ]"), F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(run))


def counted(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): the runs of letters of all texts after the deletions, of at least ``least`` (3 or more) code points and ``times`` occurrences.

    Shorter runs can't give such a word, so the pattern skips them.
    """
    text = F.make_valid_utf8(F.coalesce(F.col("text"), F.lit("")))
    found = docs.select("doc_id", F.explode_outer(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least},}}"), F.lit(0))).alias("run")).where("run is not null")
    runs = found.select("doc_id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(h % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= times) & (F.length("word") >= least))


def halves(words: DataFrame) -> DataFrame:
    """Rows (id, side, w, bits): every word as it is (side 0) and reversed (side 1), a number for it, and the mask bit of each of its suffixes."""
    both = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w")))).alias("x")).select("x.*")
    numbered = both.select(F.monotonically_increasing_id().alias("id"), "side", "w")
    return save(numbered.mapInArrow(_with_bits, "id long, side int, w string, bits array<tinyint>"), "op13-halves")


_PIECE = pa.schema([("id", pa.int64()), ("depth", pa.int32()), ("node", pa.int64()), ("next", pa.int32()), ("mark", pa.int32()), ("mask", pa.int64())])


def _hashed(words: list[str]):
    """Of words put end to end: code points (and a 0), where each word starts, its length, the sums of prefixes, the bit of the suffix at every place 0 to its length."""
    length = np.array([len(w) for w in words])
    codes = np.append(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), 0).astype(np.uint64)
    start = np.cumsum(length) - length
    most = int(length.max()) + 1
    powers = np.multiply.accumulate(np.full(most, _BASE, np.uint64))
    back = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(most, pow(_BASE, -1, 1 << 64), np.uint64))])
    place = np.arange(len(codes) - 1) - np.repeat(start, length)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[:-1] * powers[place])])
    of = np.repeat(np.arange(len(words)), length + 1)
    at = np.arange(len(of)) - np.repeat(np.cumsum(length + 1) - length - 1, length + 1)
    rest = (sums[(start + length)[of]] - sums[start[of] + at]) * back[at]
    bits = ((rest ^ (rest >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return codes, start, length, sums, bits


def _with_bits(batches):
    for batch in batches:
        words = batch.column("w").to_pylist()
        if words:
            *_, length, _, bits = _hashed(words)
            ends = np.concatenate([[0], np.cumsum(length + 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bits.astype(np.int8)))], ["id", "side", "w", "bits"])


def _path_hashes(ids: list[int], sides: list[int], words: list[str]) -> pa.RecordBatch:
    codes, start, length, sums, bits = _hashed(words)
    side = np.array(sides)
    begin, enter = (length - 1 + side) // 2, (length + side) // 2
    n = length - begin + 1
    of = np.repeat(np.arange(len(words)), n)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of]
    node = sums[start[of] + depth] - sums[start[of]] + ((depth * 2 + side[of]).astype(np.uint64) << np.uint64(44))
    node = (node ^ (node >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    following = np.where(depth < length[of], codes[start[of] + depth], 0)
    mark = (depth == begin[of]) | (depth == enter[of])
    mask = np.uint64(1) << bits[start[of] + of + depth]
    columns = (np.array(ids)[of], depth, node.view(np.int64), following, mark, mask.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.type.to_pandas_dtype())) for c, t in zip(columns, _PIECE)], schema=_PIECE)


def _pieces(batches):
    """The nodes on the last half of every word's path: (id, depth, node, next, mark, mask).

    node is a hash of the path, next the following code point, 0 at the end. mark: a
    word enters here, or its half begins here, so that the node must stay in the
    compressed trie; mask has the bit of the rest of the word. Words of some ``LETTERS`` in all are put into one batch.
    """
    held, letters = [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            held.append(tuple(v.as_py() for v in row))
            letters += len(held[-1][2])
            if letters >= LETTERS:
                yield _path_hashes(*map(list, zip(*held)))
                held, letters = [], 0
    if held:
        yield _path_hashes(*map(list, zip(*held)))


class Trie:
    """The compressed trie of the last halves: ``edges`` (side, node, label, child, target, mask) and ``states`` (side, w, bits, pos, node), those without an edit."""

    def __init__(self, words: DataFrame):
        listed = halves(words)
        pieces = listed.select("id", "side", "w").mapInArrow(_pieces, "id long, depth int, node long, next int, mark int, mask long")
        nodes = pieces.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("b"), F.max("mark").alias("mark"), F.bit_or("mask").alias("mask"))
        stay = save(nodes.where("a <> b or a = 0 or mark = 1").select("node", "mask"), "op13-nodes")
        path = pieces.drop("mask").join(stay, "node").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "mask"))).alias("path"))  # as many as the word has branches
        paths = save(path.join(listed, "id").drop("id"), "op13-paths")
        step = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b"))))
        each = paths.where("size(path) > 1").select("side", "w", step.alias("s"))
        edge = each.select("side", F.col("s.a.node").alias("node"), F.col("s.b.node").alias("child"), F.expr("substring(w, s.a.depth + 1, s.b.depth - s.a.depth)").alias("label"), F.when(F.col("s.b.depth") == F.length("w"), F.col("w")).alias("target"), F.col("s.b.mask").alias("mask"))
        self.edges = save(edge.groupBy("side", "node", "child", "label").agg(F.max("target").alias("target"), F.bit_or("mask").alias("mask")), "op13-edges")
        enter = F.floor((F.length("w") + F.col("side")) / 2).cast("int")
        own = paths.withColumn("enter", enter).select("side", "w", "bits", F.explode(F.filter("path", lambda p: p["depth"] >= F.col("enter"))).alias("p"))
        self.states = own.select("side", "w", "bits", F.col("p.depth").alias("pos"), F.col("p.node").alias("node"))


def one_edit(a, b) -> F.Column:
    """Whether two strings differ by exactly one inserted, deleted or replaced code point; long ones are compared by their first difference."""
    length, other = F.length(a), F.length(b)
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
    rest = lambda x, i: F.substring(x, i, F.length(x))
    replaced = (length == other) & (rest(a, at + 1) == rest(b, at + 1))
    longer, shorter = (length == other + 1) & (rest(a, at + 1) == rest(b, at)), (other == length + 1) & (rest(a, at) == rest(b, at + 1))
    return F.when(F.abs(length - other) > 1, False).when(other <= 64, F.levenshtein(a, b, 1) == 1).otherwise((at > 0) & (replaced | longer | shorter))


def _edited() -> F.Column:
    """The positions at which a word comes out of the edge (label, child, mask) after one edit on it: an array, often empty."""
    k, pos, left = F.length("label"), F.col("pos"), F.length("w") - F.col("pos")

    def to(n, also) -> F.Column:
        """``n`` code points of the word stand against the label."""
        part = F.substring(F.col("w"), pos + 1, n)
        open_ = F.call_function("shiftright", F.col("mask"), F.get("bits", pos + n).cast("int")).bitwiseAND(1) == 1
        return F.when((n <= left) & open_ & also(part) & ((k == 1) | one_edit(part, F.col("label"))), F.array(pos + n))

    none = F.array().cast("array<int>")
    replaced, inserted = to(k, lambda part: part < F.col("label")), to(k - 1, lambda part: F.lit(True))
    return F.concat(F.coalesce(replaced, none), F.coalesce(inserted, none))


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (word, near) of all words of ``words`` (word) that differ by exactly one inserted, deleted or replaced code point, both ways."""
    trie = Trie(words)
    moved = trie.states.join(trie.edges, ["side", "node"]).select("side", "w", F.col("child").alias("node"), "target", F.explode_outer(_edited()).alias("pos"))
    states, found, level = moved.where("pos is not null"), [], 0
    following = trie.edges.select("side", "node", F.substring("label", 1, 1).alias("head"), "label", "child", F.col("target").alias("next"))
    ended, rest = F.col("pos") == F.length("w"), F.substring(F.col("w"), F.col("pos") + 1, F.length("w"))
    while level == 0 or states.limit(1).count():
        # States at the end of their word have no next code point, and so no edge; they stay if they are neighbours.
        step = states.withColumn("head", F.substring(rest, 1, 1)).join(following, ["side", "node", "head"], "left")
        step = step.where(F.when(ended, F.col("target").isNotNull()).otherwise(rest.startswith(F.col("label"))))
        on = lambda c, then: F.when(ended, F.col(c)).otherwise(then).alias(c)
        after = save(step.select("side", "w", on("node", F.col("child")), on("target", F.col("next")), on("pos", F.col("pos") + F.length("label")), ended.alias("done")), f"op13-states{level}")
        found.append(after.where("done").select("side", "w", "target"))
        states, level = after.where("not done").drop("done"), level + 1
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    back = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    both = pairs.select(back("w").alias("a"), back("target").alias("b")).where(one_edit(F.col("a"), F.col("b")))
    told = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"))))
    return both.select(told.alias("x")).select("x.*").distinct()


def variants(docs: DataFrame, least: int = LEAST_LENGTH, times: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one per word of ``docs`` (doc_id, text).

    A null doc_id stands as nothing before the colon of the hash; null and empty texts
    have no words; in text that isn't valid UTF-8, U+FFFD stands for what isn't. Rows of one
    doc_id and repeated rows all count. Words of any length are walked alike. Other
    columns are ignored, an empty table has no rows.
    """
    words = save(counted(docs, least, times), "op13-words")
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form")))  # ties: the least in code points
    near = near_pairs(words).join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    likely = -F.col("best.n") >= TIMES * F.col("n")
    table = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(likely, F.col("best.form")).alias("form"), F.when(likely, -F.col("best.n")).alias("form_n"))
    table = save(table, "op13-forms")
    forms = table.where("form is not null").select(F.col("word").alias("from"), F.col("form").alias("to"))
    # A form is ten times as frequent as its variant, so chains have as many steps as counts have digits.
    open_, ends, level = table.where("form is not null").select("word", F.col("form").alias("root")), None, 0
    while ends is None or open_.limit(1).count():
        step = save(open_.join(forms, F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNull().alias("last")), f"op13-roots{level}")
        done = step.where("last").select("word", "root")
        ends, open_, level = done if ends is None else ends.union(done), step.where("not last").select("word", "root"), level + 1
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
