"""Call linking: signature index, match modes, edges and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming


def signatures(methods: DataFrame) -> DataFrame:
    """A1: the arities of each (class_name, name)."""
    return methods.groupBy("class_name", "name").agg(F.sort_array(F.collect_set("param_count")).alias("arities"))


def select_mode(arities: Column, args: Column, tolerance: int | None = None, by_signature: bool = True) -> Column:
    """Exact, fallback, tolerant or none."""
    has = F.size(F.coalesce(arities, F.array().cast("array<int>"))) > 0
    if not by_signature:
        return F.when(has, "fallback").otherwise("none")
    mode = F.when(~has, "none").when(F.array_contains(arities, args), "exact").when(F.size(arities) == 1, "fallback")
    if tolerance is not None:
        mode = mode.when(F.array_min(F.transform(arities, lambda c: F.abs(c - args))) <= tolerance, "tolerant")
    return mode.otherwise("none")


def nearest_arity(arities: Column, args: Column) -> Column:
    """The arity nearest to the number of arguments; of two the lesser."""
    return F.array_min(F.transform(arities, lambda c: F.struct(F.abs(c - args).alias("off"), c.alias("c"))))["c"]


def link(raw: DataFrame, methods: DataFrame, tolerance: int | None = None, by_signature: bool = True) -> DataFrame:
    """Valid raw calls, each once, with ``mode`` and ``arity``, the parameters of the method they link to."""
    return linked(raw.distinct(), methods, tolerance, by_signature)


def linked(raw: DataFrame, methods: DataFrame, tolerance: int | None = None, by_signature: bool = True) -> DataFrame:
    """``link`` with repeated calls as often as they stand in ``raw``: enough for ``edges``, which tells each once anyway."""
    valid = raw.where("caller <> '' and callee <> '' and caller_class <> ''")
    sig = signatures(methods).select(F.col("class_name").alias("callee_class"), F.col("name").alias("callee"), "arities")
    joined = valid.join(sig, ["callee_class", "callee"], "left")
    mode = F.when(F.col("callee_class") == "Unknown", "none").otherwise(select_mode(F.col("arities"), F.col("arg_count"), tolerance, by_signature))
    joined = joined.withColumn("mode", mode)
    arity = F.when(F.col("mode") == "exact", F.col("arg_count")).when(F.col("mode").isin("fallback", "tolerant"), nearest_arity(F.col("arities"), F.col("arg_count")))
    return joined.select(*raw.columns, "mode", arity.alias("arity"))


def edges(links: DataFrame) -> DataFrame:
    """One edge per (caller, callee, type); unlinked external calls become unknown edges, internal ones vanish."""
    known = F.col("mode") != "none"
    found = links.where(known | (F.col("type") == "external"))
    callee_class, kind = F.when(known, F.col("callee_class")), F.when(known, F.col("type")).otherwise("unknown")
    return found.select("caller", "caller_class", "callee", callee_class.alias("callee_class"), kind.alias("type")).distinct()


def edge_details(links: DataFrame) -> DataFrame:
    """Edges with via_field (F19) and the match mode and argument count of the last raw call by (arg_count, mode)."""
    known = links.where("mode <> 'none'").groupBy("caller", "caller_class", "callee", "callee_class", "type").agg(F.max(F.struct("arg_count", "mode")).alias("r"))
    return known.select("caller", "caller_class", "callee", "callee_class", "type", F.concat_ws("_to_", "caller", "callee").alias("via_field"), F.col("r.arg_count").alias("arg_count"), F.col("r.mode").alias("match_mode"))


def link_statistics(raw: DataFrame, links: DataFrame) -> DataFrame:
    """A5: the counters of a linking run, in one row."""
    per = links.agg(
        F.count("*").alias("deduplicated_rows"),
        F.count_if(F.col("type") == "internal").alias("internal_rows"),
        F.count_if(F.col("type") == "external").alias("external_rows"),
        F.count_if(F.col("callee_class") == "Unknown").alias("direct_unknown_rows"),
        F.count_if(F.col("mode") == "exact").alias("signature_exact_hits"),
        F.count_if(F.col("mode") == "fallback").alias("unique_fallback_hits"),
        F.count_if(F.col("mode") == "tolerant").alias("tolerant_hits"),
        F.count_if((F.col("mode") == "none") & (F.col("type") == "external")).alias("unmatched_to_unknown"),
        F.count_if((F.col("mode") == "none") & (F.col("type") == "internal")).alias("internal_unmatched_dropped"),
    )
    return raw.agg(F.count("*").alias("total_rows")).join(per)


def unknown_nodes(calls: DataFrame) -> DataFrame:
    """External method names with the category they're stored with."""
    return calls.where("type = 'unknown'").select(F.col("callee").alias("name")).distinct().withColumn("category", naming.write_category(F.col("name")))
