"""Operator 5: mixing sources to target weights by entropy balancing.

Documents get rates r that stay as near as possible, in relative entropy over
words, to taking everything once, subject to one word constraint a source:
sum(size * r) = target. The convex dual has one multiplier a source, its optimum
tilts the rates exponentially, r = exp(multiplier), and its Hessian is diagonal.
The only sums over documents that a Newton step needs are the sizes by source,
so these are aggregated once, with map-side combining, and the iterations run on
the rows of the source table. Further columns may have targets of their own
(``also``): then r = min(most, exp(sum of the multipliers of the document's
values)), the sums over documents are those of the combinations of values
(cells), and Newton's method goes round the columns, whose blocks of the Hessian
are diagonal, on the table of cells. Rates are then rounded into whole copies:
every document gets floor(r), and a threshold on a content hash, found by a radix
select, gives one copy more to as many words as are missing.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, save

WEIGHTS = (5, 2, 1)
MOST = 3
NEWTON_STEPS = 60
#: With further columns: rounds at the most, and the share of a target that may be missing at the end.
ROUNDS, NEAR = 40, 1e-6
#: Hash digits that the radix select settles, and how many in one step: 16^STEP bins a source.
DIGITS, STEP = 6, 2
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def _newton(target: Column, size: Column) -> Column:
    """The multiplier of one source: Newton's method on sum(size) * exp(x) - target * x, steps clipped to 2."""
    step = lambda x, _: x + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), target / (size * F.exp(x)) - 1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)


def with_keys(docs: DataFrame, also=()) -> DataFrame:
    """Add __size (words), __sk (the source's key; null is a source of its own) and __u (a content hash).

    With further columns ``also``, __m0 is the source's key, __m1 and so on are
    theirs, and __sk is that of the cell.
    """
    text = F.coalesce("text", F.lit(""))
    key = lambda c: F.when(F.col(f"`{c}`").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(f"`{c}`").cast("string")))
    keys = {f"__m{i}": key(c) for i, c in enumerate(["source", *also])}
    cell = key("source") if not also else F.concat(*(x for k in keys.values() for x in (F.length(k), F.lit(":"), k)))
    return docs.withColumns({
        "__size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "__sk": cell,
        "__u": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text)),
        **(keys if also else {}),
    })


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Add weight and target to the source table (__sk, source, source_size).

    Sources in code point order, null last, take the weights in turn. Sources
    whose share exceeds ``most`` times their size stop there and the rest is
    shared anew: in the order of size by weight, a source is capped if its cap
    isn't above what the words and weights left over would give it.
    """
    everything = Window.partitionBy(F.lit(1))
    ranked = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    table = ranked.withColumn("weight", choice.cast("double")).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("level", left / weight_left)
    table = table.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.coalesce(F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(everything)["level"], F.lit(0.0))
    return table.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)).drop("level", "cap", "capped", "rank")


def balanced(keyed: DataFrame, weights, most: int, also: dict) -> DataFrame:
    """The table of cells for several constraints: __sk, source_size and target of the source, cell_size, rate.

    A step for one column's multipliers is Newton's on log(sum of size * rate) =
    log(target), which is concave in the multiplier, so that it never passes the
    solution from below. Where the targets can't all be met together, as cells are
    missing or at the most, the sources' come last in each round and are met best.
    """
    margins = {f"__m{i}": w for i, w in enumerate([weights, *also.values()])}
    at = save(keyed.groupBy("__sk", *margins).agg(F.sum("__size").alias("cell_size")).withColumn("x", F.lit(0.0)), "op5-cells")
    wanted = {}
    for key, w in margins.items():
        sizes = at.groupBy(key).agg(F.sum("cell_size").alias("source_size")).withColumn("source", F.when(F.col(key).startswith("s"), F.expr(f"substring({key}, 2)")))
        wanted[key] = save(targets(sizes, w, most).select(key, "source_size", "target"), "op5-margin")
    size, top = F.col("cell_size"), math.log(most)

    def sums(cells: DataFrame, key: str) -> DataFrame:
        free = F.sum(F.when(F.col("x") < top, size * F.exp("x")).otherwise(0.0))
        have = F.sum(size * F.exp(F.least("x", F.lit(top))))
        return cells.groupBy(key).agg(have.alias("have"), free.alias("free"), F.min("x").alias("least")).join(wanted[key], key).where("target > 0")

    last = math.inf
    for n in range(ROUNDS):
        for key in reversed(margins):
            log = F.ln(F.col("target") / F.col("have"))
            step = F.when(F.col("free") > 0, log * F.col("have") / F.col("free")).otherwise(log - F.greatest(F.col("least") - top, F.lit(0.0)))
            steps = sums(at, key).select(key, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), step)).alias("step"))
            at = at.join(steps, key, "left").withColumn("x", F.col("x") + F.coalesce("step", F.lit(0.0))).drop("step")
        at = save(at, f"op5-round{n}")
        gap = max(sums(at, key).agg(F.max(F.abs(F.col("have") / F.col("target") - 1))).first()[0] or 0.0 for key in margins)
        if gap < NEAR or (n > 9 and gap > 0.99 * last):  # met, or as near as it gets
            break
        last = gap
    return at.join(wanted["__m0"], "__m0").select("__sk", "source_size", "target", "cell_size", F.when(size > 0, F.exp(F.least("x", F.lit(top)))).otherwise(0.0).alias("rate"))


def plan(keyed: DataFrame, weights=WEIGHTS, most: int = MOST, also: dict | None = None) -> DataFrame:
    """The source table (with ``also``: that of the cells): __sk, source_size, target, rate, and how rates become copies.

    copies = base, plus one where __u is below or at the cut (bin, last).
    """
    if also:
        table = balanced(keyed, weights, most, also)
        wanted = F.col("rate") * F.col("cell_size")
    else:
        sizes = keyed.groupBy("__sk", "source").agg(F.sum("__size").alias("source_size"))
        table = targets(sizes, weights, most).withColumn("cell_size", F.col("source_size"))
        table = table.withColumn("rate", F.when(F.col("target") > 0, F.exp(_newton(F.col("target"), F.col("source_size")))).otherwise(0.0))
        wanted = F.col("target")
    table = table.withColumn("base", F.least(F.lit(most), F.floor("rate")).cast("long"))
    table = save(table.withColumn("missing", F.when(F.col("base") < most, wanted - F.col("base") * F.col("cell_size")).otherwise(0.0)), "op5-sources")

    # Radix select: of each source's bins of one more digit, the one in which the missing words end.
    upto = Window.partitionBy("__sk").orderBy("bin")
    cut = table.select("__sk", "missing", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for n in range(STEP, DIGITS + 1, STEP):
        inside = keyed.select("__sk", "__size", F.substring("__u", 1, n - STEP).alias("prefix"), F.substring("__u", 1, n).alias("bin")).join(cut, ["__sk", "prefix"])
        bins = inside.groupBy("__sk", "missing", "before", "bin").agg(F.sum("__size").alias("words")).withColumn("after", F.col("before") + F.sum("words").over(upto))
        chosen = bins.where("after > missing and after - words <= missing").select("__sk", "missing", F.col("bin").alias("prefix"), (F.col("after") - F.col("words")).alias("before"))
        cut = save(chosen, f"op5-cuts{n}")
    inside = keyed.withColumn("prefix", F.substring("__u", 1, DIGITS)).join(cut, ["__sk", "prefix"]).groupBy("__sk", "__u").agg(F.sum("__size").alias("words"), F.first("before").alias("before"), F.first("missing").alias("missing"))
    at = F.col("before") + F.sum("words").over(Window.partitionBy("__sk").orderBy("__u")) - F.col("words") / 2
    last = inside.withColumn("at", at).where("at <= missing").groupBy("__sk").agg(F.max("__u").alias("last"))
    cut = cut.select("__sk", F.col("prefix").alias("bin")).join(last, "__sk", "left")
    # No cut bin: nothing is missing (base is exact or at the most), or all of it is.
    full = F.col("missing") >= F.col("cell_size")
    table = table.join(cut, "__sk", "left").withColumn("bin", F.coalesce("bin", F.when(full, "z").otherwise("")))
    return save(table.select("__sk", "source_size", "target", "rate", "base", "bin", F.coalesce("last", F.lit("")).alias("last")), "op5-plan")


def mixed(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """``keyed`` with the columns of its source's plan and the copies, all named with two underscores."""
    small = table.count() <= BROADCAST_SOURCES
    table = table.select("__sk", *(F.col(c).alias(f"__{c}") for c in table.columns if c != "__sk"))
    digit = F.substring("__u", 1, DIGITS)
    extra = (digit < F.col("__bin")) | ((digit == F.col("__bin")) & (F.col("__u") <= F.col("__last")))
    return keyed.join(F.broadcast(table) if small else table, "__sk").withColumn("__copies", F.when(F.col("__size") > 0, F.col("__base") + extra.cast("long")).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, also: dict | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    ``also`` maps further columns to weights, by which their values share all words
    as the sources do by theirs (a column called like ours gives no clash).
    Null text has size 0 and is never taken; other columns are ignored. The choice depends on
    doc_id and text alone, so reruns agree, and equal rows of a source are taken
    alike. A source's (with ``also``: a cell's) words differ from its target by less than half a document
    (or half a set of equal rows). An empty table has no rows.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", *(F.col(f"`{c}`").alias(f"__also{i}") for i, c in enumerate(also or ())))
    keyed = save(with_keys(chosen, [f"__also{i}" for i in range(len(also or ()))]).drop("text"), "op5-sizes")
    out = mixed(keyed, plan(keyed, weights, most, also))
    return out.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target")), (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, also: dict | None = None) -> DataFrame:
    """The mixture itself: every row of ``docs`` as many times as it has copies, numbered in a new last column.

    That column is called copy, with as many underscores behind it as keep it from
    clashing with a given one. The sizes and hashes of the texts are computed once.
    """
    number = "copy"
    while number in map(str.lower, docs.columns):
        number += "_"
    keyed = save(with_keys(docs, list(also or ())), "op5-documents")
    out = mixed(keyed, plan(keyed.select("source", "__size", "__sk", "__u", *(c for c in keyed.columns if c.startswith("__m"))), weights, most, also)).where("__copies > 0")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias(number))
