"""Degrees, hotspots and structural risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, naming


def out_degrees(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges out of every method, zero where there are none."""
    n = calls.groupBy(F.col("caller").alias("name"), F.col("caller_class").alias("class_name")).agg(F.count("*").alias("out_degree"))
    return nodes.join(n, ["name", "class_name"], "left").select("name", "class_name", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def in_degrees(nodes: DataFrame, known: DataFrame) -> DataFrame:
    n = known.groupBy(F.col("callee").alias("name"), F.col("callee_class").alias("class_name")).agg(F.count("*").alias("in_degree"))
    return nodes.join(n, ["name", "class_name"], "left").select("name", "class_name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def caller_counts(nodes: DataFrame, raw: DataFrame, top: int = 20) -> DataFrame:
    """A2: raw calls made by each method, repeats counted; the ``top`` most frequent."""
    n = raw.groupBy(F.col("caller").alias("name"), F.col("caller_class").alias("class_name")).agg(F.count("*").alias("n"))
    both = nodes.join(n, ["name", "class_name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.orderBy(F.desc("n"), "class_name", "name").limit(top)


def hot_nodes(known: DataFrame, top: int = 20) -> DataFrame:
    """The methods with most callers."""
    n = known.groupBy(F.col("callee").alias("name"), F.col("callee_class").alias("class_name")).agg(F.count("*").alias("in_degree"))
    return n.orderBy(F.desc("in_degree"), "class_name", "name").limit(top)


def call_statistics(calls: DataFrame) -> DataFrame:
    """Edges by type, and their sum."""
    count = lambda t: F.count_if(F.col("type") == t)
    return calls.agg(count("internal").alias("internal"), count("external").alias("external"), count("unknown").alias("unknown"), F.count("*").alias("total"))


def isolated(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Methods without any edge."""
    out = calls.select(F.col("caller").alias("name"), F.col("caller_class").alias("class_name"))
    into = calls.where("callee_class is not null").select(F.col("callee").alias("name"), F.col("callee_class").alias("class_name"))
    return nodes.join(out.union(into).distinct(), ["name", "class_name"], "left_anti")


def integrity(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """How many methods, and how many are isolated."""
    return nodes.agg(F.count("*").alias("methods")).join(isolated(nodes, calls).agg(F.count("*").alias("isolated")))


def class_pairs(known: DataFrame) -> DataFrame:
    return known.where("caller_class <> callee_class").groupBy(F.col("caller_class").alias("a"), F.col("callee_class").alias("b")).agg(F.count("*").alias("n"))


def class_cycles(known: DataFrame) -> DataFrame:
    """Pairs of classes that call one another."""
    pairs = class_pairs(known)
    back = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("reverse"))
    return pairs.where("a < b").join(back, ["a", "b"]).select("a", "b", F.col("n").alias("forward"), "reverse")


def method_cycles(known: DataFrame) -> DataFrame:
    """Pairs of methods that call one another."""
    e = known.select(naming.method_key(F.col("caller_class"), F.col("caller")).alias("a"), naming.method_key(F.col("callee_class"), F.col("callee")).alias("b")).distinct()
    return e.where("a < b").join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])


def bucketed(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges by the coarse buckets of both ends; class paths are a left join with defaults."""
    path = classes.groupBy("name").agg(F.min("file_path").alias("path"))
    pairs = known.groupBy("caller_class", "callee_class").agg(F.count("*").alias("n"))
    a = path.select(F.col("name").alias("caller_class"), F.col("path").alias("from_path"))
    b = path.select(F.col("name").alias("callee_class"), F.col("path").alias("to_path"))
    both = pairs.join(a, "caller_class", "left").join(b, "callee_class", "left")
    return both.select("caller_class", "callee_class", "n", naming.coarse_bucket(F.col("from_path"), F.col("caller_class")).alias("from_bucket"), naming.coarse_bucket(F.col("to_path"), F.col("callee_class")).alias("to_bucket"))


def violations(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Class pairs whose buckets may not call one another, with their edges."""
    bad = F.lit(False)
    for a, b in fixed.FORBIDDEN:
        bad = bad | ((F.col("from_bucket") == a) & (F.col("to_bucket") == b))
    return bucketed(known, classes).where(bad)


def violation_rate(known: DataFrame, classes: DataFrame) -> DataFrame:
    bad = violations(known, classes).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return known.agg(F.count("*").alias("edges")).join(bad).select("edges", "violations", naming.ratio(F.col("violations"), F.col("edges")).alias("rate"))


def god_methods(nodes: DataFrame, calls: DataFrame, above: int = 100) -> DataFrame:
    """Methods with more than ``above`` edges out."""
    return out_degrees(nodes, calls).where(F.col("out_degree") > above)


def god_classes(nodes: DataFrame, above: int = 60, top: int = 20) -> DataFrame:
    """Classes with more than ``above`` methods."""
    n = nodes.groupBy("class_name").agg(F.count("*").alias("methods")).where(F.col("methods") > above)
    return n.orderBy(F.desc("methods"), "class_name").limit(top)


def hotspot_share(nodes: DataFrame, known: DataFrame, top: int = 20) -> DataFrame:
    """The share of calls that the ``top`` most called methods receive."""
    n = in_degrees(nodes, known)
    best = n.orderBy(F.desc("in_degree"), "class_name", "name").limit(top).agg(F.sum("in_degree").alias("top_sum"))
    return n.agg(F.sum("in_degree").alias("total")).join(best).select("top_sum", "total", naming.ratio(F.col("top_sum"), F.col("total")).alias("share"))


def degree_histogram(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Methods by ranges of out-degree, one column a range."""
    d = F.col("out_degree")
    return out_degrees(nodes, calls).agg(
        F.count_if(d == 0).alias("d0"), F.count_if(d.between(1, 5)).alias("d1_5"), F.count_if(d.between(6, 20)).alias("d6_20"),
        F.count_if(d.between(21, 50)).alias("d21_50"), F.count_if(d.between(51, 100)).alias("d51_100"), F.count_if(d > 100).alias("d100_up"))


def cross_prefix(calls: DataFrame, top: int = 15) -> DataFrame:
    """Edges between classes of different name prefixes."""
    e = calls.where("callee_class is not null and caller_class <> callee_class").select(naming.prefix_layer(F.col("caller_class")).alias("a"), naming.prefix_layer(F.col("callee_class")).alias("b")).where("a <> b")
    return e.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top)


def prefix_distribution(nodes: DataFrame) -> DataFrame:
    """Classes and methods by the prefix layer of the class name."""
    per = nodes.groupBy("class_name").agg(F.count("*").alias("m"))
    return per.groupBy(naming.prefix_layer(F.col("class_name")).alias("prefix")).agg(F.count("*").alias("classes"), F.sum("m").alias("methods"))


def annotation_counts(classes: DataFrame) -> DataFrame:
    """How many classes are mappers, and how many are controllers or services by path."""
    return classes.agg(F.count_if("is_mapper").alias("mappers"), F.count_if(F.col("layer").isin("controller", "service")).alias("services"))


def diagnostics(nodes: DataFrame, classes: DataFrame, calls: DataFrame) -> DataFrame:
    """Counts of the graph's tables and of what lacks a partner."""
    named = classes.select(F.col("name").alias("class_name")).distinct()
    lone = nodes.join(named, "class_name", "left_anti").agg(F.count("*").alias("orphan_methods"))
    empty = named.join(nodes, "class_name", "left_anti").agg(F.count("*").alias("empty_classes"))
    return named.agg(F.count("*").alias("classes")).join(nodes.agg(F.count("*").alias("methods"))).join(calls.agg(F.count("*").alias("calls"))).join(lone).join(empty)


def size_summary(nodes: DataFrame, classes: DataFrame, calls: DataFrame) -> DataFrame:
    """Sizes and the share of resolved edges."""
    e = calls.agg(F.count("*").alias("calls"), F.count_if(F.col("type") == "unknown").alias("unknown"))
    return classes.agg(F.count("*").alias("classes")).join(nodes.agg(F.count("*").alias("methods"))).join(e).withColumn("resolve_rate", naming.ratio(F.col("calls") - F.col("unknown"), F.col("calls")))


def unknown_names(calls: DataFrame, top: int = 20) -> DataFrame:
    """The unresolved names with most edges."""
    return calls.where("type = 'unknown'").groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def fan_out(calls: DataFrame, most: int = fixed.FAN_OUT) -> DataFrame:
    """At most ``most`` callees of each method, in name order."""
    rank = Window.partitionBy("caller", "caller_class").orderBy("callee_class", "callee", "type")
    return calls.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)
