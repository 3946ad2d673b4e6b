"""Inference passes over unknown edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, naming

EDGE = ["caller", "caller_class", "callee", "callee_class", "reason", "confidence"]


def _candidates(methods: DataFrame) -> DataFrame:
    return methods.select(F.col("name").alias("callee"), F.col("class_name").alias("callee_class")).distinct()


def unique_name(unknown: DataFrame, methods: DataFrame) -> DataFrame:
    """Callees whose name only one class defines."""
    only = _candidates(methods).groupBy("callee").agg(F.min("callee_class").alias("callee_class"), F.count("*").alias("n")).where("n = 1").drop("n")
    return unknown.join(only, "callee").select("caller", "caller_class", "callee", "callee_class", F.lit("unique_name").alias("reason"), F.lit(1.0).alias("confidence"))


def _prefixes(path) -> F.Column:
    """Every leading part of a path's directories as (length, text), the longest last."""
    d = naming.dirs(path)
    n = F.size(d)
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("shared"), F.array_join(F.slice(d, F.lit(1), i), "/").alias("prefix")))


def path_proximity(unknown: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Of several candidates the one whose path shares most leading directories with the caller's, at least one.

    Candidates are reduced to the least class of each (name, directory prefix), and a
    caller's class looks its own prefixes up: no pair of a caller and a candidate is
    ever made, however many classes define a name. The choice is made once for each
    pair of a caller's class and a name.
    """
    several = _candidates(methods).join(_candidates(methods).groupBy("callee").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "callee")
    path = classes.groupBy("name").agg(F.min("file_path").alias("path"))
    offered = several.join(path.select(F.col("name").alias("callee_class"), "path"), "callee_class").select("callee", "callee_class", F.explode(_prefixes(F.col("path"))).alias("p"))
    least = offered.groupBy("callee", "p").agg(F.min("callee_class").alias("callee_class"))
    asked = unknown.select("caller_class", "callee").distinct().join(path.select(F.col("name").alias("caller_class"), "path"), "caller_class").select("caller_class", "callee", F.explode(_prefixes(F.col("path"))).alias("p"))
    best = asked.join(least, ["callee", "p"]).groupBy("caller_class", "callee").agg(F.max_by(F.struct("callee_class", "p.shared"), F.col("p.shared")).alias("b"))
    best = best.select("caller_class", "callee", "b.callee_class", "b.shared")
    confidence = F.round(F.least(F.lit(1.0), F.lit(0.3) + F.lit(0.15) * F.col("shared")), 2)
    return unknown.join(best, ["caller_class", "callee"]).select("caller", "caller_class", "callee", "callee_class", F.concat(F.lit("path_proximity:"), F.col("shared").cast("string")).alias("reason"), confidence.alias("confidence"))


def mapper_proxy(unknown: DataFrame, methods: DataFrame, classes: DataFrame, confidence: float = fixed.MAPPER_CONFIDENCE) -> DataFrame:
    """Every mapper class that defines the name."""
    mappers = classes.where("is_mapper").select(F.col("name").alias("callee_class")).distinct()
    found = unknown.join(_candidates(methods).join(mappers, "callee_class"), "callee")
    return found.select("caller", "caller_class", "callee", "callee_class", F.lit("mybatis_mapper").alias("reason"), F.lit(confidence).alias("confidence"))


def infer(unknown: DataFrame, methods: DataFrame, classes: DataFrame, mapper_confidence: float = fixed.MAPPER_CONFIDENCE) -> DataFrame:
    """The three passes in turn; each sees only what its predecessors left unknown."""
    key = ["caller", "caller_class", "callee"]
    first = unique_name(unknown, methods)
    left = unknown.join(first.select(*key), key, "left_anti")
    second = path_proximity(left, methods, classes)
    left = left.join(second.select(*key), key, "left_anti")
    return first.unionByName(second).unionByName(mapper_proxy(left, methods, classes, mapper_confidence))


def left_unknown(unknown: DataFrame, inferred: DataFrame) -> DataFrame:
    """Unknown edges that no pass resolved; names that vanish from it are purged nodes."""
    key = ["caller", "caller_class", "callee"]
    return unknown.join(inferred.select(*key).distinct(), key, "left_anti")


def merged(calls: DataFrame, inferred: DataFrame) -> DataFrame:
    """The edge table with inferred edges as external calls, and without the unknown ones they replace."""
    edge = ["caller", "caller_class", "callee", "callee_class", "type"]
    known = calls.where("type <> 'unknown'").select(*edge)
    new = inferred.select("caller", "caller_class", "callee", "callee_class", F.lit("external").alias("type"))
    left = left_unknown(calls.where("type = 'unknown'"), inferred)
    return known.union(new).distinct().unionByName(left.select(*edge))


def purged_names(unknown: DataFrame, inferred: DataFrame) -> DataFrame:
    """Names of external methods that no unknown edge leads to any more."""
    left = left_unknown(unknown, inferred).select(F.col("callee").alias("name"))
    return unknown.select(F.col("callee").alias("name")).distinct().join(left, "name", "left_anti")


def reason_counts(inferred: DataFrame) -> DataFrame:
    """Edges by reason, the overlap of path_proximity folded away."""
    return inferred.groupBy(F.regexp_replace("reason", ":.*", "").alias("reason")).agg(F.count("*").alias("n"))


def resolve_potential(unknown: DataFrame, methods: DataFrame) -> DataFrame:
    """Unknown edges whose name has no, one or several candidates."""
    n = _candidates(methods).groupBy("callee").agg(F.count("*").alias("n"))
    return unknown.join(n, "callee", "left").agg(
        F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("no_candidate"), F.count_if(F.col("n") == 1).alias("unique_candidate"), F.count_if(F.col("n") > 1).alias("ambiguous"))
