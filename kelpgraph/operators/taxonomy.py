"""Unknown calls: categories and their callers; domains and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, naming


def categorised(unknown: DataFrame) -> DataFrame:
    """Unknown edges with their stored and their actionable category."""
    stored = naming.write_category(F.col("callee"))
    return unknown.select("caller", "caller_class", "callee", stored.alias("stored"), naming.unknown_category(stored, F.col("callee"), F.col("caller_class")).alias("category"))


def breakdown(unknown: DataFrame) -> DataFrame:
    """A count per category, none left out."""
    c = F.col("category")
    return categorised(unknown).agg(*(F.count_if(c == x).alias(x) for x in fixed.UNKNOWN_CATEGORIES), F.count("*").alias("total"), F.count_if(c != "jdk_core").alias("business"))


def top_callers(unknown: DataFrame, top: int = 15) -> DataFrame:
    """Classes with most unknown calls, their share and dominant category (of equals the first in the fixed order)."""
    per = categorised(unknown).groupBy("caller_class", "category").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, fixed.UNKNOWN_CATEGORIES)), F.col("category"))
    cls = per.groupBy("caller_class").agg(F.sum("n").alias("unknown"), F.min(F.struct((-F.col("n")).alias("neg"), order.alias("o"), "category"))["category"].alias("dominant"))
    total = unknown.agg(F.count("*").alias("total"))
    return cls.join(total).select("caller_class", "unknown", naming.ratio(F.col("unknown"), F.col("total")).alias("share"), "dominant").orderBy(F.desc("unknown"), "caller_class").limit(top)


def util_unknown(unknown: DataFrame) -> DataFrame:
    """unknown calls made by utility classes."""
    return unknown.agg(F.count_if(naming.is_util(F.col("caller_class"))).alias("util"), F.count("*").alias("total"))


def layered(classes: DataFrame) -> DataFrame:
    """Every class with layer, priority, domain and bucket, from its path and name."""
    path = F.col("file_path")
    return classes.select("name", "file_path", naming.layer(path).alias("layer"), naming.domain(path).alias("domain"), naming.coarse_bucket(path, F.col("name")).alias("bucket")).withColumn("priority", naming.layer_priority(F.col("layer")))


def layer_statistics(classes: DataFrame) -> DataFrame:
    """Classes by layer."""
    return layered(classes).groupBy("layer", "priority").agg(F.count("*").alias("class_count"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("class_names"))


def other_ratio(classes: DataFrame) -> DataFrame:
    """Classes without a layer."""
    return layered(classes).agg(F.count_if(F.col("layer") == "other").alias("other_count"), F.count("*").alias("classes")).withColumn("other_ratio", naming.ratio(F.col("other_count"), F.col("classes")))


def domain_rollup(classes: DataFrame, nodes: DataFrame, unknown: DataFrame, entries: DataFrame) -> DataFrame:
    """Classes, methods, unknown calls and entries of each domain that owns a class."""
    domain = classes.select(F.col("name").alias("class_name"), naming.domain(F.col("file_path")).alias("domain")).groupBy("class_name").agg(F.min("domain").alias("domain"))
    per = lambda table, column, name: table.groupBy(F.col(column).alias("class_name")).agg(F.count("*").alias(name))
    wide = domain.join(per(nodes, "class_name", "m"), "class_name", "left").join(per(unknown, "caller_class", "u"), "class_name", "left").join(per(entries, "class_name", "e"), "class_name", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return wide.groupBy("domain").agg(F.count("*").alias("classes"), total("m").alias("methods"), total("u").alias("unknown_calls"), total("e").alias("entries"))
