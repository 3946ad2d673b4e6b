"""Critical chains: loading, evaluation, suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import naming
from ..sources.tables import save

HOPS = "array<struct<class:string,method:string>>"


def normalised(raw: DataFrame) -> DataFrame:
    """Chains (name, hops) from rows (name, hops as JSON texts), pairs or objects; two valid hops at least."""
    pair = lambda h: F.from_json(h, "array<string>")
    hop = lambda h: F.struct(F.trim(F.coalesce(F.get_json_object(h, "$.class"), F.get(pair(h), 0))).alias("class"), F.trim(F.coalesce(F.get_json_object(h, "$.method"), F.get(pair(h), 1))).alias("method"))
    hops = F.filter(F.transform("hops", hop), lambda x: (F.coalesce(x["class"], F.lit("")) != "") & (F.coalesce(x["method"], F.lit("")) != ""))
    return raw.where("name is not null and name <> ''").select("name", hops.alias("hops")).where(F.size("hops") >= 2)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Chains of a JSON file {"chains": [{"name", "hops"}]}."""
    rows = spark.read.text(path, wholetext=True)
    raw = rows.select(F.explode(F.from_json("value", "chains array<struct<name:string,hops:array<string>>>")["chains"]).alias("c")).select("c.name", "c.hops")
    return normalised(raw)


def pairs(chains: DataFrame) -> DataFrame:
    """Rows (name, pos, from, to) for consecutive hops."""
    n = F.size("hops") - 1
    step = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("hops", i).alias("a"), F.get("hops", i + 1).alias("b")))
    return chains.where(n > 0).select("name", F.posexplode(step).alias("pos", "p")).select("name", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def matched(chains: DataFrame, known: DataFrame) -> DataFrame:
    """Q5: per chain its hops, the matched ones, and ``b``, the first that is not: pos and both its methods."""
    edge = known.select(F.col("caller_class").alias("ac"), F.col("caller").alias("am"), F.col("callee_class").alias("bc"), F.col("callee").alias("bm")).distinct().withColumn("hit", F.lit(True))
    flat = pairs(chains).select("name", "pos", F.col("a.class").alias("ac"), F.col("a.method").alias("am"), F.col("b.class").alias("bc"), F.col("b.method").alias("bm"))
    flat = flat.join(edge, ["ac", "am", "bc", "bm"], "left")
    broken = F.col("hit").isNull()
    return flat.groupBy("name").agg(F.count("*").alias("total_hops"), F.count_if(~broken).alias("matched_hops"), F.min(F.when(broken, F.struct("pos", "ac", "am", "bc", "bm"))).alias("b"))


def evaluate(chains: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per chain its hops, the matched ones, and where and why it breaks first.

    Only the hop at which a chain breaks first is asked whether its methods are defined.
    """
    defined = nodes.select(F.col("class_name").alias("c"), F.col("name").alias("m")).distinct().withColumn("def", F.lit(True))
    out = matched(chains, known).select("name", "total_hops", "matched_hops", "b.*")
    for side in ("a", "b"):
        out = out.join(defined.select(F.col("c").alias(f"{side}c"), F.col("m").alias(f"{side}m"), F.col("def").alias(f"{side}def")), [f"{side}c", f"{side}m"], "left")
    why = F.when(F.col("adef").isNull() | F.col("bdef").isNull(), "missing_method_definition").otherwise("missing_call")
    return out.select("name", "total_hops", "matched_hops", (F.col("total_hops") == F.col("matched_hops")).alias("full_hit"), F.col("pos").alias("first_break"), F.when(F.col("pos").isNotNull(), why).alias("reason"))


def suggest(entries: DataFrame, known: DataFrame, max_hops: int = 5, per_prefix: int = 2, prefix: int = 3, count: int = 10) -> DataFrame:
    """Greedy chains from entries (name, class_name, entry_score).

    Each step takes the unvisited callee of greatest score (3 internal, 2 external,
    plus the role bonus of its class; ties by class, then name). Equal chains keep
    the best entry score; of chains with one core (the ``prefix`` hops after the
    entry) ``per_prefix`` stay; the ``count`` best are returned.
    """
    score = F.when(F.col("type") == "internal", 3).otherwise(2)
    steps = known.groupBy("caller_class", "caller", "callee_class", "callee").agg(F.max(score).alias("own")).withColumn("score", F.col("own") + naming.role_bonus(F.col("callee_class")))
    steps = save(steps, "steps")
    node = lambda c, m: F.struct(F.col(c).alias("class"), F.col(m).alias("method"))
    walk = entries.select(F.concat_ws("_", F.lit("auto"), "class_name", "name").alias("name"), "entry_score", F.array(node("class_name", "name")).alias("hops"), F.lit(0).alias("type_score"))
    ended = None
    for hop in range(1, max_hops):
        last = F.element_at("hops", -1)
        cur = walk.withColumn("caller_class", last["class"]).withColumn("caller", last["method"])
        nxt = cur.join(steps, ["caller_class", "caller"]).where(~F.array_contains("hops", node("callee_class", "callee")))
        best = nxt.groupBy("name").agg(F.min_by(F.struct(node("callee_class", "callee").alias("n"), "own"), F.struct(-F.col("score"), "callee_class", "callee")).alias("b"))
        both = save(walk.join(best, "name", "left"), f"suggest{hop}")
        stop = both.where("b is null").drop("b")
        ended = stop if ended is None else ended.unionByName(stop)
        walk = both.where("b is not null").select("name", "entry_score", F.array_append("hops", F.col("b.n")).alias("hops"), (F.col("type_score") + F.col("b.own")).alias("type_score"))
    every = (walk if ended is None else ended.unionByName(walk)).where(F.size("hops") >= 2)
    once = every.groupBy("hops").agg(F.max(F.struct("entry_score", "type_score", "name")).alias("r")).select("hops", "r.*")
    order = [F.size("hops").desc(), F.desc("type_score"), F.desc("entry_score"), F.asc("name")]
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy(F.slice("hops", 2, prefix)).orderBy(*order))).where(F.col("r") <= per_prefix)
    return ranked.orderBy(*order).limit(count).select("name", "hops", "entry_score", "type_score")
