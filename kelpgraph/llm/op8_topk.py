"""Operator 8: exact top-k search over binary codes by incremental multi-index hashing.

Vectors become 64-bit sign codes. A code is cut into m segments; each distinct
code is indexed under the value of every segment. The search probes all values
within radius r = 0, 1, 2, ... of the query's segments. By the pigeonhole
principle every code within distance m (r + 1) - 1 has been met after radius r,
so a query is finished as soon as its kth verified distance is no larger; only
unfinished queries go on to the next radius.

Rows that share a code share an index entry with their k least ids (more can't
be in any answer), and queries that share a code are searched once, so a vector
that a third of the rows have costs as much as any other.

Segments have at most ``MOST_BITS`` bits, so the flips of a radius are at most
``MOST_BITS`` over its half a segment, 51 480 rows in all, whatever the table holds.
Codes near to no other need large radii, where the probes of a query would meet more
codes than there are; such queries are compared with every code instead, in
broadcast blocks, which is exact as well.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, comb, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

BITS = 64
MOST_BITS = 16
#: A radius whose probes would meet this many times the codes there are costs more than a look at each code.
SCAN_AT = 1.0
#: Queries that are broadcast to the codes at once, and rows of one segment's value that one task looks at.
BLOCK = 50_000
SPLIT = 100_000


def sign_code(embedding: str) -> Column:
    """Bit i is set if the elements i, i + 64, ... sum to more than zero; null for null or empty vectors."""
    e = F.col(embedding)
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    folded = lambda i: F.aggregate(F.filter(e, lambda _, at: at % BITS == i), F.lit(0.0), lambda s, x: s + number(x))
    value = lambda i: F.when(F.size(e) > BITS, folded(i)).otherwise(number(F.get(e, i)))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), none, lambda code, i: code.bitwiseOR(F.when(value(i) > 0, F.call_function("shiftleft", one, i)).otherwise(none)))
    return F.when(F.size(e) > 0, bits)


def _segments(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of segments of about log2(n) - 3 bits: a value holds eight codes on average.

    Looking a value up costs several times as much as verifying a code; at eight
    codes a value both kinds of work are about equal.
    """
    m = max(ceil(BITS / MOST_BITS), min(8, round(BITS / max(1.0, log2(max(2, n)) - 3))))
    edge = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, distance): the k nearest of ``vectors`` for each of ``queries``.

    Both have vec_id and embedding. Nearest by Hamming distance of the codes, then
    by vec_id; a query that is also a vector finds itself. Vectors without a code
    (null, empty) are neither found nor answered; null ids are left out as
    vectors. Repeated rows count as often as they occur. With fewer than k
    vectors all are returned.
    """
    spark = vectors.sparkSession
    coded = vectors.select("vec_id", sign_code("embedding").alias("code")).where("code is not null and vec_id is not null")
    ranked = coded.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("n") <= k)
    codes = save(ranked.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "op8-codes")
    asked = save(queries.select(F.col("vec_id").alias("query_id"), sign_code("embedding").alias("q")).where("q is not null"), "op8-queries")

    counted = codes.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).first()
    segments = _segments(counted["n"])
    want = min(k, counted["ids"] or 0)
    part = lambda c, j: F.shiftrightunsigned(c, segments[j][0]).bitwiseAND(F.lit((1 << segments[j][1]) - 1).cast("long"))
    entry = codes.select("code", F.col("ids")[0].alias("first_id"), F.size("ids").alias("n_ids"))
    index = entry.select("*", F.posexplode(F.array(*(part("code", j) for j in range(len(segments))))).alias("seg", "value"))
    # A value that very many codes share is cut into pieces, and its probes go to each of them. Such values are at most codes * segments / SPLIT.
    pieces = save(index.groupBy("seg", "value").count().where(F.col("count") > SPLIT).select("seg", "value", F.ceil(F.col("count") / SPLIT).cast("int").alias("pieces")), "op8-pieces")
    few = pieces.count() <= BLOCK
    cut = F.broadcast(pieces) if few else pieces
    index = save(index.join(cut, ["seg", "value"], "left").withColumn("piece", F.pmod(F.xxhash64("code"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces"), "op8-index")
    numbers = spark.range(1 << max(bits for _, bits in segments)).select(F.col("id").alias("mask"), F.bit_count("id").alias("flipped"))

    order = Window.partitionBy("q").orderBy("d", "first_id")
    best_of = lambda met: met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    finished: list[DataFrame] = []
    now = None
    open_queries = save(asked.select("q").distinct(), "op8-open")
    for radius in range(max(bits for _, bits in segments) + 1):
        if sum(comb(bits, radius) / 2**bits for _, bits in segments) > SCAN_AT:
            finished += _scanned(entry, open_queries, now, k, best_of)
            break
        at = F.array(*(F.struct(F.lit(j).alias("seg"), F.lit(1 << bits).cast("long").alias("end")) for j, (_, bits) in enumerate(segments)))
        flips = F.broadcast(numbers.where(F.col("flipped") == radius).select("mask", F.explode(at).alias("s")).where("mask < s.end").select("s.seg", "mask"))
        parts = open_queries.select("q", F.posexplode(F.array(*(part("q", j) for j in range(len(segments))))).alias("seg", "own"))
        probes = parts.join(flips, "seg").select("q", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        every = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)).alias("piece")
        probes = probes.join(cut, ["seg", "value"], "left").select("q", "seg", "value", every)
        met = probes.join(index, ["seg", "value", "piece"]).select("q", "code", "first_id", "n_ids", _distance())
        if now is not None:
            met = met.union(now.join(open_queries, "q", "left_semi"))
        now = save(best_of(met.distinct()), f"op8-radius{radius}")
        within = len(segments) * (radius + 1) - 1
        done = now.where(F.col("d") <= within).groupBy("q").agg(F.sum("n_ids").alias("have")).where(F.col("have") >= want).select("q")
        finished.append(now.join(done, "q", "left_semi"))
        open_queries = save(open_queries.join(done, "q", "left_anti"), f"op8-open{radius}")
        if not open_queries.limit(1).count():
            break
    best = reduce(DataFrame.union, finished)
    listed = best.join(codes, "code").select("q", "d", F.explode("ids").alias("vec_id"))
    rank = Window.partitionBy("q").orderBy("d", "vec_id", "copy")
    listed = listed.withColumn("copy", F.row_number().over(Window.partitionBy("q", "d", "vec_id").orderBy(F.lit(1))))
    answer = listed.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return asked.join(answer, "q").select("query_id", "rank", "vec_id", F.col("d").alias("distance"))


def _distance() -> Column:
    return F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("d")


def _scanned(entry: DataFrame, open_queries: DataFrame, now: DataFrame, k: int, best_of) -> list[DataFrame]:
    """The ``k`` best codes of every open query among all codes, in blocks of about BLOCK queries.

    Of a query that has met k codes only those as near as the last of them count.
    """
    met = now.groupBy("q").agg(F.max("d").alias("worst"), F.count("*").alias("n")).where(F.col("n") >= k)
    asked = save(open_queries.join(met, "q", "left").select("q", F.coalesce("worst", F.lit(BITS)).alias("worst")), "op8-outliers")
    blocks = max(1, ceil(asked.count() / BLOCK))
    found = []
    for block in range(blocks):
        mine = F.broadcast(asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block))
        near = entry.join(mine).select("q", "code", "first_id", "n_ids", _distance(), "worst").where("d <= worst").drop("worst")
        found.append(save(best_of(near), f"op8-scan{block}"))
    return found
