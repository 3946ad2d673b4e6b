"""Entry points: additive rules, their trace, and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, naming
from .degrees import out_degrees


def rules(path: Column, cls: Column, method: Column, degree: Column) -> list[tuple[str, int, Column]]:
    """(rule, score, condition), in the order of the trace; names are compared in lower case."""
    p, c, m = naming.norm_path(F.coalesce(path, F.lit(""))), F.lower(cls), F.lower(method)
    begins = lambda x, names: x.rlike("^(?:" + "|".join(names) + ")")
    ends = lambda x, names: x.rlike("(?:" + "|".join(names) + ")$")
    return [
        ("layer.controller_action", 8, naming.layer(path).isin("controller", "action")),
        ("path.entry_like_segment", 4, p.rlike("/(?:interf|interface|api|web|struts|job|batch|task|schedule)/")),
        ("class.suffix_action_controller", 8, ends(c, ("action", "controller"))),
        ("class.suffix_interf_api", 4, ends(c, ("interf", "api"))),
        ("class.suffix_job_batch", 5, ends(c, ("job", "batch"))),
        ("method.name_entry_exact", 7, m.isin("execute", "invoke", "process", "dispatch")),
        ("method.prefix_do_send", 4, begins(m, ("do", "send"))),
        ("method.prefix_entry_like", 2, begins(m, ("do", "handle", "submit", "query", "list", "get", "find", "send"))),
        ("fanout.ge_1", 1, degree >= 1),
        ("fanout.ge_3", 2, degree >= 3),
        ("fanout.ge_10", 2, degree >= 10),
        ("penalty.getter_setter_no_fanout", -5, begins(m, ("set", "get", "is")) & (degree == 0)),
    ]


def scored(nodes: DataFrame, classes: DataFrame, calls: DataFrame) -> DataFrame:
    """Every method with out_degree, entry_score, entry_rule_trace and entry_confidence."""
    path = classes.groupBy(F.col("name").alias("class_name")).agg(F.min("file_path").alias("file_path"))
    both = out_degrees(nodes, calls).join(path, "class_name", "left")
    made = rules(F.col("file_path"), F.col("class_name"), F.col("name"), F.col("out_degree"))
    trace = F.filter(F.array(*(F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(delta).alias("delta"))) for rule, delta, cond in made)), lambda x: x.isNotNull())
    both = both.withColumn("entry_rule_trace", trace).withColumn("entry_score", F.aggregate("entry_rule_trace", F.lit(0), lambda a, x: a + x["delta"]))
    return both.withColumn("entry_confidence", F.when(F.col("entry_score") >= 18, "high").when(F.col("entry_score") >= 12, "medium").otherwise("low"))


def entries(nodes: DataFrame, classes: DataFrame, calls: DataFrame, pool: int = fixed.ENTRY_POOL, least: int = fixed.ENTRY_SCORE, limit: int = fixed.ENTRY_LIMIT) -> DataFrame:
    """T4: of the ``pool`` methods with most edges out those that score at least ``least``, the ``limit`` best."""
    first = scored(nodes, classes, calls).orderBy(F.desc("out_degree"), "name", "class_name").limit(pool)
    return first.where(F.col("entry_score") >= least).orderBy(F.desc("entry_score"), F.desc("out_degree"), "class_name", "name").limit(limit)


def rule_hits(found: DataFrame, top: int = 10) -> DataFrame:
    """How often each rule applies."""
    hits = found.select(F.explode("entry_rule_trace").alias("t")).groupBy(F.col("t.rule").alias("rule")).agg(F.count("*").alias("hits"))
    return hits.orderBy(F.desc("hits"), "rule").limit(top)


def confidence_counts(found: DataFrame) -> DataFrame:
    c = F.col("entry_confidence")
    out = found.agg(F.count("*").alias("entries"), F.count_if(c == "high").alias("high"), F.count_if(c == "medium").alias("medium"), F.count_if(c == "low").alias("low"))
    return out.withColumn("high_share", naming.ratio(F.col("high"), F.col("entries")))


def without_downstream(found: DataFrame, known: DataFrame) -> DataFrame:
    """Entries that call no known method."""
    return found.join(known.select(F.col("caller").alias("name"), F.col("caller_class").alias("class_name")).distinct(), ["name", "class_name"], "left_anti").select("name", "class_name")
