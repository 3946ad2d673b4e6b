"""Graph traversal level by level.

A level is one join of the frontier with the edges and one anti join with what
was met before; the tables are written after each level, so plans stay short and
a lost executor costs one level. Nothing but level counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, naming
from ..sources.tables import save


#: Rows a level's join must make before the other way is weighed.
DENSE = 5_000_000
#: Nodes in a word of bits.
_BITS = 62


def clamp(depth: int | None, hard: int = fixed.HARD_DEPTH) -> int:
    """F16: depths lie in 1..hard."""
    return max(1, min(hard, fixed.DEPTH if depth is None else depth))


def keyed(known: DataFrame) -> DataFrame:
    """Edges (s, d, type) between method keys."""
    return known.select(naming.method_key(F.col("caller_class"), F.col("caller")).alias("s"), naming.method_key(F.col("callee_class"), F.col("callee")).alias("d"), "type")


def numbered(nodes: DataFrame) -> DataFrame:
    """Rows (node, id): ids from 0 in the order of the nodes, given out by range, no task seeing them all."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = save(nodes.distinct().repartitionByRange(parts, "node").withColumn("part", F.spark_partition_id()), "nodes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1
    return save(dealt.withColumn("place", place).join(F.broadcast(starts), "part").select("node", (F.col("start") + F.col("place")).alias("id")), "numbers")


def _words(pairs: DataFrame, of: str, ids: DataFrame) -> DataFrame:
    """Rows (of, word, bits): the nodes of each ``of`` as bits, 62 a word, so that no word is negative."""
    bit = F.expr(f"shiftleft(1L, cast(id % {_BITS} as int))")
    return pairs.select(of, "node").distinct().join(ids, "node").groupBy(of, F.expr(f"id div {_BITS}").alias("word")).agg(F.bit_or(bit).alias("bits"))


def _pulled(frontier: DataFrame, into: DataFrame, ids: DataFrame, kinds: DataFrame, sources: DataFrame, met: DataFrame) -> DataFrame:
    """Rows (origin, node, e) as a join of the frontier with the steps would give for what wasn't met: each looks for its least predecessor in the frontier."""
    open_ = sources.select("origin").distinct().crossJoin(into.select(F.col("next").alias("node")).distinct()).join(met.select("origin", "node"), ["origin", "node"], "left_anti")
    front = _words(frontier, "origin", ids).withColumnRenamed("bits", "there")
    both = open_.join(into.withColumnRenamed("next", "node"), "node").join(front, ["origin", "word"]).withColumn("both", F.col("bits").bitwiseAND(F.col("there"))).where("both <> 0")
    first = both.groupBy("origin", "node").agg(F.min(F.struct("word", "both")).alias("m"))
    via = first.select("origin", "node", F.expr(f"m.word * {_BITS} + bit_count(~m.both & (m.both - 1))").alias("id")).join(ids.withColumnRenamed("node", "via"), "id")
    return via.join(kinds, ["via", "node"]).select("origin", "node", F.struct("via", "type").alias("e"))


def reach(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, up: bool = False) -> DataFrame:
    """Rows (origin, node, depth, type, via) for what each origin reaches.

    ``sources`` has origin and node. depth is the least number of edges; via and type
    are those of the last edge (``up``: the first one), the least if several are as
    short. The origin itself is met only where it lies on a cycle.

    A level joins the frontier with the steps, or, where that makes more rows than
    there are nodes left to meet and words of predecessors to look through, goes the
    other way: what an origin hasn't met looks for its predecessors in the frontier, 62
    in one comparison. In a dense graph the first level or two meet nearly everything.
    """
    steps = save(edges.select(F.col("d" if up else "s").alias("node"), F.col("s" if up else "d").alias("next"), "type").distinct(), "steps")  # read at every level
    ways = steps.groupBy("node").agg(F.count("*").alias("ways"))
    frontier = sources.select("origin", "node").distinct()
    met: DataFrame | None = None
    into = ids = kinds = None
    least = pushed = 0
    for depth in range(1, clamp(max_depth) + 1):
        if met is not None and into is None and pushed > DENSE:
            ids = numbered(steps.select("node"))
            into = save(_words(steps, "next", ids), "into")
            kinds = steps.groupBy(F.col("node").alias("via"), F.col("next").alias("node")).agg(F.min("type").alias("type"))
            targets, words = into.agg(F.count_distinct("next"), F.count("*")).first()
            least = sources.select("origin").distinct().count() * targets
        if into is not None and least + (least - met.count()) * (words / max(1, targets)) < pushed:
            found = _pulled(frontier, into, ids, kinds, sources, met)
        else:
            found = frontier.join(steps, "node").groupBy("origin", F.col("next").alias("node")).agg(F.min(F.struct(F.col("node").alias("via"), "type")).alias("e"))
        found = found.select("origin", "node", F.lit(depth).alias("depth"), F.col("e.type").alias("type"), F.col("e.via").alias("via"))
        if met is not None:
            found = found.join(met.select("origin", "node"), ["origin", "node"], "left_anti")
        found = save(found, f"reach{depth}")
        n, pushed = found.join(ways, "node", "left").agg(F.count("*"), F.coalesce(F.sum("ways"), F.lit(0))).first()
        if not n:
            return found if met is None else met
        met = found if met is None else met.unionByName(found)
        frontier = found.select("origin", "node")
    return met


def around(edges: DataFrame, sources: DataFrame, hops: int, lines: int) -> DataFrame:
    """Rows (origin, node, depth): the ``lines`` first, by depth and node, of what each origin reaches and of what reaches it within ``hops`` edges, both ways together.

    A node that is met at one depth on both ways counts once. Later levels come behind
    earlier ones, so an origin that has its lines goes no further: from the second
    level on a frontier has fewer than ``lines`` nodes an origin, however dense the graph.
    """
    once = save(edges.select("s", "d").distinct(), "steps")
    way = lambda name, a, b: once.select(F.lit(name).alias("way"), F.col(a).alias("node"), F.col(b).alias("next"))
    steps = way("down", "s", "d").unionByName(way("up", "d", "s"))
    ways = F.explode(F.array(F.lit("down"), F.lit("up"))).alias("way")
    frontier = sources.select("origin", "node").distinct().select("origin", "node", ways, F.lit(0).alias("n"))
    met: DataFrame | None = None
    place = F.dense_rank().over(Window.partitionBy("origin").orderBy("node"))
    for depth in range(1, clamp(hops) + 1):
        found = frontier.join(steps, ["way", "node"]).select("origin", "way", F.col("next").alias("node"), "n").distinct()
        if met is not None:
            found = found.join(met.select("origin", "way", "node"), ["origin", "way", "node"], "left_anti")
        first = found.withColumn("place", place).where(F.col("place") <= lines)
        kept = first.select("origin", "way", "node", F.lit(depth).alias("depth"), (F.col("n") + F.col("place")).alias("place")).where(F.col("place") <= lines)
        kept = save(kept, f"around{depth}")
        met = kept if met is None else met.unionByName(kept)
        count = kept.groupBy("origin").agg(F.max("place").alias("n")).where(F.col("n") < lines)
        frontier = kept.select("origin", "node", "way").join(count, "origin")
        if depth < clamp(hops) and not frontier.limit(1).count():
            break
    return met.select("origin", "node", "depth").distinct()


def reachable(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The nodes that any source reaches, sources included; one traversal for all of them."""
    start = sources.select(F.lit("*").alias("origin"), "node").distinct()
    return reach(edges, start, max_depth).select("node").union(start.select("node")).distinct()


def shortest_path(edges: DataFrame, starts: DataFrame, end: str, max_depth: int | None = None) -> DataFrame:
    """Per origin the nodes of one shortest path to ``end``, the least in order of its nodes; start = end is one node."""
    steps = save(edges.select(F.col("s").alias("node"), F.col("d").alias("next")).distinct(), "steps")
    paths = starts.select("origin", "node", F.array("node").alias("path"))
    done = paths.where(F.col("node") == end).select("origin", "path")
    frontier, seen = paths.where(F.col("node") != end), paths.select("origin", "node")
    for depth in range(1, clamp(max_depth) + 1):
        grown = frontier.join(steps, "node").select("origin", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"))
        grown = grown.groupBy("origin", "node").agg(F.min("path").alias("path")).join(seen, ["origin", "node"], "left_anti")
        grown = save(grown, f"path{depth}")
        done = done.unionByName(grown.where(F.col("node") == end).select("origin", "path"))
        left = grown.join(grown.where(F.col("node") == end).select("origin"), "origin", "left_anti")
        if not left.limit(1).count():
            break
        frontier, seen = left, seen.union(grown.select("origin", "node"))
    return done


def _steps(edges: DataFrame, fan_out: int) -> DataFrame:
    """Rows (node, next, type): the first ``fan_out`` callees of each node by name."""
    rank = Window.partitionBy("s").orderBy("d", "type")
    steps = edges.groupBy("s", "d").agg(F.min("type").alias("type")).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= fan_out)
    return save(steps.select(F.col("s").alias("node"), F.col("d").alias("next"), "type"), "steps")


def _tree_roots(roots: DataFrame) -> DataFrame:
    return roots.select("root", F.array("root").alias("path"), F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("truncated"))


def _grown(open_: DataFrame, steps: DataFrame, depth: int, max_depth: int) -> DataFrame:
    """The children of the nodes ``open_`` (root, path, node), which lie at ``depth``."""
    cut = F.when(F.array_contains("path", F.col("next")), "cycle").when(F.lit(depth == max_depth), "max_depth")
    return open_.select("root", "path", "node").join(steps, "node").select("root", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("node"), F.lit(depth).alias("depth"), "type", cut.alias("truncated"))


def call_tree(edges: DataFrame, roots: DataFrame, max_depth: int = 3, fan_out: int = fixed.FAN_OUT) -> DataFrame:
    """Rows (root, path, node, depth, type, truncated) of every path from a root.

    Each node has at most ``fan_out`` children, in name order. A path ends where its
    node is on it already (cycle) or at the greatest depth (max_depth).
    """
    steps = _steps(edges, fan_out)
    out = level = _tree_roots(roots)
    for depth in range(1, max_depth + 1):
        level = save(_grown(level.where("truncated is null"), steps, depth, max_depth), f"tree{depth}")
        out = out.unionByName(level)
    return out


def first_of_tree(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, fan_out: int = fixed.FAN_OUT, most: int = fixed.TREE_NODES) -> DataFrame:
    """``budgeted(call_tree(...), most)`` without the rest of the tree; adds place, from 1 on.

    The paths of a tree grow with the power of its depth, the first ``most`` in
    pre-order don't: a node's children are looked up only if, counting the nodes met
    before it and the children of the open ones among them, one has a place left.
    So a level makes at most most + fan_out rows a root, whatever the depth.
    """
    steps = _steps(edges, fan_out)
    degrees = steps.groupBy("node").agg(F.count("*").alias("children"))
    order = Window.partitionBy("root").orderBy("path")
    met = _tree_roots(roots.distinct()).withColumn("place", F.lit(1))
    limit = clamp(max_depth)
    for depth in range(1, limit + 1):
        open_ = (F.col("depth") == depth - 1) & F.col("truncated").isNull()
        counted = met.join(degrees, "node", "left").withColumn("adds", F.when(open_, F.coalesce("children", F.lit(0))).otherwise(0))
        ahead = F.sum(F.col("adds") + 1).over(order) - F.col("adds")
        level = _grown(counted.withColumn("ahead", ahead).where(open_ & (F.col("ahead") < most)), steps, depth, limit)
        met = met.drop("place").unionByName(level).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        met = save(met, f"tree{depth}")
        if not met.where((F.col("depth") == depth) & F.col("truncated").isNull()).limit(1).count():
            break
    return met


def budgeted(tree: DataFrame, most: int = fixed.TREE_NODES) -> DataFrame:
    """The first ``most`` nodes of each tree in pre-order, which is the order of their paths."""
    return tree.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy("path"))).where(F.col("place") <= most)


def neighbours(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Direct callees and callers of each focus node."""
    down = edges.select("s", "d").distinct().groupBy(F.col("s").alias("node")).agg(F.count("*").alias("downstream"))
    up = edges.select("s", "d").distinct().groupBy(F.col("d").alias("node")).agg(F.count("*").alias("upstream"))
    return focus.join(down, "node", "left").join(up, "node", "left").select("node", F.coalesce("downstream", F.lit(0)).alias("downstream"), F.coalesce("upstream", F.lit(0)).alias("upstream"))


def view(reached: DataFrame, classes: DataFrame, up: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``reach`` found as a drawing: nodes (origin, node, depth, layer) and edges (origin, source, target, type, dashed).

    Every edge leads between two methods that were met, in the direction of the call.
    """
    path = classes.groupBy(F.col("name").alias("class_name")).agg(F.min("file_path").alias("path"))
    focus = reached.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"))
    every = reached.select("origin", "node", "depth").unionByName(focus).groupBy("origin", "node").agg(F.min("depth").alias("depth"))
    nodes = every.withColumn("class_name", F.regexp_replace("node", r"\.[^.]*$", "")).join(path, "class_name", "left").select("origin", "node", "depth", F.coalesce(naming.layer(F.col("path")), F.lit("other")).alias("layer"))
    ends = ("node", "via") if up else ("via", "node")
    edges = reached.select("origin", F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"), "type", (F.col("type") != "internal").alias("dashed"))
    return nodes, edges
