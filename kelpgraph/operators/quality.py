"""The quality report: metrics, their change, hints, gate, catalogue and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, naming
from ..sources.tables import save
from . import chains as chain_ops
from . import degrees, entries as entry_ops, taxonomy, traverse


def metrics(classes: DataFrame, nodes: DataFrame, calls: DataFrame, chains: DataFrame, max_depth: int = fixed.DEPTH) -> DataFrame:
    """Q1: the 16 metrics as rows (metric, value); a ratio with nothing to divide by is 0."""
    # Every part below reads these; they are derived once.
    calls, nodes, chains = save(calls, "report-calls"), save(nodes, "report-nodes"), save(chains, "report-chains")
    known, unknown = calls.where("type <> 'unknown'"), calls.where("type = 'unknown'")
    found = save(entry_ops.entries(nodes, classes, calls), "report-entries")
    key = naming.method_key(F.col("class_name"), F.col("name"))
    reached = save(traverse.reachable(traverse.keyed(known), found.select(key.alias("node")), max_depth), "report-reached")
    judged = chain_ops.matched(chains, known)
    critical = save(chains.select(F.explode("hops").alias("h")).select(naming.method_key(F.col("h.class"), F.col("h.method")).alias("node")).distinct(), "report-critical")
    count = lambda table, name: table.agg(F.count("*").alias(name))
    parts = [
        count(calls, "calls"), count(nodes, "methods"), count(found, "entries"), count(reached, "reached"),
        count(found.where("entry_confidence = 'high'"), "high"),
        taxonomy.breakdown(unknown).select(F.col("total").alias("unknown"), F.col("business")),
        taxonomy.util_unknown(unknown).select("util"),
        judged.agg(F.count("*").alias("chains"), F.count_if(F.col("total_hops") == F.col("matched_hops")).alias("hit"), F.coalesce(F.sum("total_hops"), F.lit(0)).alias("hops"), F.coalesce(F.sum("matched_hops"), F.lit(0)).alias("hops_hit")),
        count(critical, "critical"), count(critical.join(reached, "node", "left_semi"), "critical_reached"),
        count(critical.join(nodes.select(key.alias("node")), "node", "left_semi"), "critical_defined"),
        degrees.violation_rate(known, classes).select("rate"), count(degrees.class_cycles(known), "cycles"),
        count(degrees.god_methods(nodes, calls), "gods"), count(degrees.isolated(nodes, calls), "isolated"),
        degrees.hotspot_share(nodes, known).select("share"),
    ]
    row = reduce(lambda a, b: a.join(b), parts)  # each has one row
    r = lambda a, b: naming.ratio(F.col(a), F.col(b))
    values = {
        "broken_chain_rate": r("unknown", "calls"),
        "business_broken_chain_rate": r("business", "calls"),
        "reachability_rate": r("reached", "methods"),
        "key_chain_hit_rate": r("hit", "chains"),
        "critical_chain_retention": r("hops_hit", "hops"),
        "critical_hop_dropout": 1 - r("hops_hit", "hops"),
        "util_unknown_ratio": r("util", "unknown"),
        "critical_chain_coverage": r("critical_reached", "critical"),
        "critical_chain_reach_share": r("critical", "reached"),
        "critical_definition_presence": r("critical_defined", "critical"),
        "entry_confidence_proxy": r("high", "entries"),
        "layer_violation_rate": F.col("rate"),
        "cycle_count": F.col("cycles").cast("double"),
        "god_method_ratio": r("gods", "methods"),
        "isolated_method_ratio": r("isolated", "methods"),
        "hotspot_fragility_top20_share": F.col("share"),
    }
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.round(v, 6).alias("value")) for k, v in values.items()))).alias("m")).select("m.*")


def change(now: DataFrame, before: DataFrame) -> DataFrame:
    """Q2, Q4: metrics in both reports, with their difference."""
    return now.join(before.withColumnRenamed("value", "previous"), "metric").select("metric", "previous", "value", (F.col("value") - F.col("previous")).alias("delta"))


def top_changes(changed: DataFrame, top: int = 5) -> DataFrame:
    """Q3, T8."""
    return changed.orderBy(F.desc(F.abs("delta")), "metric").limit(top)


def gate(report: DataFrame, optional: dict[str, float] | None = None) -> DataFrame:
    """Every threshold with the metric's value and whether it holds; a missing metric fails.

    ``optional`` adds upper bounds on further metrics.
    """
    rows = [*fixed.GATE, *((m, "<=", b, False) for m, b in (optional or {}).items())]
    bounds = report.sparkSession.createDataFrame(rows, "metric string, op string, bound double, mandatory boolean")
    hops = report.where("metric = 'critical_chain_retention'").select(F.lit("key_chain_hop_hit_rate").alias("metric"), "value")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    return bounds.join(report.select("metric", "value").union(hops), "metric", "left").select("metric", "op", "bound", "mandatory", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def hints(report: DataFrame) -> DataFrame:
    """What to look at first."""
    v = F.col("value")
    said = (
        F.when((F.col("metric") == "broken_chain_rate") & (v > 0.35), "resolve unknown calls first")
        .when((F.col("metric") == "reachability_rate") & (v < 0.5), "add entry rules or depth")
        .when((F.col("metric") == "isolated_method_ratio") & (v > 0.2), "check methods without edges")
        .when((F.col("metric") == "layer_violation_rate") & (v > 0.05), "review calls across layers")
    )
    return report.select("metric", "value", said.alias("hint")).where("hint is not null")


def explain(report: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Every metric of the catalogue with its meaning, value and, given an earlier report, whether it got better.

    Metrics that a report lacks have no value. trend is better, worse, same or null.
    """
    catalogue = report.sparkSession.createDataFrame(list(fixed.CATALOGUE), "metric string, better string, shown string, meaning string")
    then = (before if before is not None else report.limit(0)).select("metric", F.col("value").alias("previous"))
    both = catalogue.join(report.select("metric", "value"), "metric", "left").join(then, "metric", "left").withColumn("delta", F.col("value") - F.col("previous"))
    up = F.when(F.col("delta") == 0, "same").when(F.col("better") == "neutral", "same").when((F.col("delta") > 0) == (F.col("better") == "higher"), "better").otherwise("worse")
    return both.select("metric", "better", "meaning", "value", "previous", "delta", F.when(F.col("delta").isNotNull(), up).alias("trend"), _shown().alias("text"))


def _shown() -> F.Column:
    """C11: a value as a percentage or as a whole number."""
    return F.when(F.col("shown") == "percent", F.format_string("%.4f %%", F.col("value") * 100)).otherwise(F.format_string("%.0f", F.col("value")))


def report_text(report: DataFrame) -> DataFrame:
    """The report as one text, a line a metric in the catalogue's order; metrics of other names follow by name."""
    order = report.sparkSession.createDataFrame([(m, i, s) for i, (m, _, s, _) in enumerate(fixed.CATALOGUE)], "metric string, place int, shown string")
    known = report.select("metric", "value").join(F.broadcast(order), "metric", "left").withColumn("place", F.coalesce("place", F.lit(1 << 30)))
    line = F.concat(F.rpad("metric", 32, " "), F.coalesce(_shown(), F.lit("-")))
    lines = F.sort_array(F.collect_list(F.struct("place", "metric", line.alias("line"))))
    return known.agg(F.concat(F.lit("Quality report\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))


def record(report: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row (run_id, json): the report as a nested object with its run and time."""
    run = F.coalesce(F.lit(run_id), F.uuid())
    found = report.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics")).select(run.alias("run_id"), "metrics")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return found.select("run_id", F.to_json(F.struct("run_id", now.alias("timestamp"), "metrics")).alias("json"))


def value_at(json: str, *keys: str) -> F.Column:
    """What a nested key of a JSON text holds; null where a step is missing."""
    return F.get_json_object(json, "$" + "".join(f"['{k}']" for k in keys))


def from_record(records: DataFrame) -> DataFrame:
    """The metrics (metric, value) of records (json); a text that can't be read has none."""
    metrics = F.from_json(value_at("json", "metrics"), "map<string,double>")
    return records.select(F.explode(metrics).alias("metric", "value"))


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """The metrics of a stored record; none where there is no file that can be read."""
    from ..sources.files import load_or_empty

    return from_record(load_or_empty(spark, path, "run_id string, json string"))
