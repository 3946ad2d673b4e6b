"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search.

Each test item is a set of hashed word shingles. Items are partitioned by size:
partition c holds those of 2^c to 2^(c+1) - 1 shingles. All items of a partition have
a *sketch* of one length, a bottom-k MinHash with k = floor((1 - threshold) u) + 1 for
its largest size u (or all shingles of smaller items). A document that contains a
share of at least ``threshold`` of an item of m shingles misses at most
``floor((1 - threshold) m)`` of them, fewer than k, so the k least can't all be
missing: the recall of the sketch search is 1, however long the document is. A MinHash
of fixed length of the document couldn't say so (its Jaccard similarity to a short
item tends to zero); its sketch is instead all its shingles up to the greatest hash
that any item's sketch holds, and grows with it.

Candidates are then verified: the item's shingles that occur in the document are
counted by their words, not their hashes. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, save, words

#: Rows of a sketch table (24 bytes each) up to which it is broadcast; beyond, the search joins by shuffle.
BROADCAST_ROWS = 1_000_000


def _let(value, use) -> F.Column:
    """``use(value)`` with ``value`` computed once a row, however often the lambda refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _each(words_of, width: int, make) -> F.Column:
    """``make`` of the words of every shingle of ``width`` words; null where there are fewer."""

    def every(w):
        return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: make([F.get(w, i + j) for j in range(width)])))

    return _let(words_of, every)


def _shingled(table: DataFrame, width: int) -> DataFrame:
    """Replace the column ``text`` by ``s``, the (hash, words) of its shingles of ``width`` words."""
    both = lambda x: F.struct(F.xxhash64(F.lit(width), *x).alias("h"), F.array(*x).alias("x"))
    return table.withColumn("s", _each(words(ascii_lower(F.col("text"))), width, both)).drop("text")


def _sketched(table: DataFrame, width: int, greatest: int) -> DataFrame:
    """Replace ``text`` by ``h``, the hashes up to ``greatest``, each once. (Exploded with explode_outer: the plain one adds a filter that computes them twice.)"""
    hashes = _each(words(ascii_lower(F.col("text"))), width, lambda x: F.xxhash64(F.lit(width), *x))
    return table.withColumn("h", F.array_distinct(F.filter(hashes, lambda h: h <= F.lit(greatest)))).drop("text")


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """Rows (item_id, width, h, x, m, k, in_sketch), one per distinct shingle of an item.

    Items of fewer than ``width`` words have one shingle, all their words; items
    without words have none.
    """
    listed = items.select("item_id", "text", F.size(words(F.col("text"))).alias("n"))
    rows = _shingled(listed.where(F.col("n") >= width), width).withColumn("width", F.lit(width))
    for n in range(1, width):
        rows = rows.union(_shingled(listed.where(F.col("n") == n), n).withColumn("width", F.lit(n)))
    return rows.select("item_id", "width", F.explode("s").alias("s")).select("item_id", "width", "s.h", "s.x").distinct()


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """Rows (item_id, width, h, m, part): the least hashes of each item, as many as its size partition ``part`` says."""
    sized = shingles.groupBy("item_id", "width").agg(F.count("*").alias("m"), F.array_sort(F.collect_set("h")).alias("all"))
    sized = sized.withColumn("part", F.floor(F.log2(F.col("m") + 0.5)).cast("int"))
    largest = F.call_function("shiftleft", F.lit(2), F.col("part")) - 1
    k = F.floor((1 - threshold) * largest + 1e-9).cast("int") + 1
    return sized.select("item_id", "width", "m", "part", F.explode(F.slice("all", F.lit(1), k)).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, dk, item_id, n_shared, n_item, containment) with containment >= ``threshold``.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored, null texts have no words and match nothing, as do items without
    words. Words are split at ASCII white space, A-Z lower-cased. dk is a key of
    the row's content: equal rows give one row of the result.
    """
    shingles = save(item_shingles(items, width), "op10-shingles")
    sketch = save(sketches(shingles, threshold), "op10-sketches")
    greatest = {r["width"]: r["h"] for r in sketch.groupBy("width").agg(F.max("h").alias("h")).collect()}  # at most ``width`` rows
    sizes = sorted(greatest)
    small = sketch.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda table: table)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("dk"), "text")
    found = None
    for n in sizes:
        hit = _sketched(keyed, n, greatest[n]).select("doc_id", "dk", F.explode_outer("h").alias("h")).where("h is not null").join(hint(sketch.where(F.col("width") == n).select("item_id", "h")), "h").select("doc_id", "dk", "item_id").distinct()
        found = hit if found is None else found.union(hit)
    if found is None:
        found = keyed.select("doc_id", "dk").join(items.select("item_id").limit(0), F.lit(True))
    pairs = save(found, "op10-candidates")

    # Verification reads only the documents of candidate pairs, and compares words.
    some = pairs.select(F.col("doc_id").alias("id"), F.col("dk").alias("key")).distinct()
    again = keyed.join(some, (F.col("dk") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    item_size = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"))
    whole = F.broadcast if shingles.count() <= BROADCAST_ROWS else (lambda table: table)
    shared = None
    for n in sizes:
        have = _shingled(again, n).select("doc_id", "dk", F.explode_outer("s").alias("s")).where("s is not null").select("doc_id", "dk", "s.h", "s.x")
        both = have.join(whole(shingles.where(F.col("width") == n).select("item_id", "h", "x")), ["h", "x"]).select("doc_id", "dk", "item_id", "h").distinct()
        shared = both if shared is None else shared.union(both)
    if shared is None:
        shared = pairs.select("doc_id", "dk", "item_id", F.lit(0).cast("long").alias("h"))
    counted = shared.groupBy("doc_id", "dk", "item_id").agg(F.count("*").alias("n_shared")).join(item_size, "item_id")
    mine = pairs.select(F.col("doc_id").alias("id"), F.col("dk").alias("key"), F.col("item_id").alias("item"))
    counted = counted.join(mine, (F.col("dk") == F.col("key")) & (F.col("item_id") == F.col("item")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    share = F.col("n_shared") / F.col("n_item")
    return counted.where(share >= threshold).select("doc_id", "dk", "item_id", "n_shared", "n_item", share.alias("containment"))


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_item, containment); rows of one doc_id count together."""
    found = contaminated(docs, items, width, threshold)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"), F.max("containment").alias("containment"))


def keep_clean(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item."""
    bad = save(contaminated(docs, items, width, threshold).select(F.col("doc_id").alias("__id"), F.col("dk").alias("__bad")).distinct(), "op10-bad")
    keyed = docs.withColumn("__dk", F.xxhash64("doc_id", "text"))
    return keyed.join(bad, (keyed["__dk"] == bad["__bad"]) & keyed["doc_id"].eqNullSafe(bad["__id"]), "left_anti").drop("__dk")
