"""Answers to questions from the graph: recall by text, context of the calls around, traces, descriptions of layers.

Summaries and questions are text; nothing here calls a model. What a user would hand
to one is the context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import naming
from ..plans.codegraph import CodeGraph
from ..sources.tables import save
from . import lexical, traverse, vectors
from .taxonomy import layered

#: Calls around a recalled method, calls down from an entry that is traced, methods of a layer's description.
HOPS, TRACE_HOPS, SAMPLES = 2, 6, 30


def method_texts(g: CodeGraph) -> DataFrame:
    """Rows (id, text): every method and its summary, by which questions find it."""
    summary = F.concat(F.lit("Method "), "name", F.lit(" of "), "class_name")
    return g.nodes.select(naming.method_key(F.col("class_name"), F.col("name")).alias("id"), summary.alias("text")).distinct()


def layer_groups(g: CodeGraph) -> DataFrame:
    """Rows (id, group): the layers that a method's class lies in."""
    home = layered(g.classes).select(F.col("name").alias("class_name"), F.col("layer").alias("group"))
    return g.nodes.join(home, "class_name").select(naming.method_key(F.col("class_name"), F.col("name")).alias("id"), "group").distinct()


def recall(g: CodeGraph, questions: DataFrame, k: int = 10, by_layer: bool = False) -> DataFrame:
    """Rows (query_id, id, score, rank): the methods that questions (query_id, text) recall; by layer: those of the question's ``group``."""
    return lexical.TextIndex(method_texts(g)).search(questions, k, layer_groups(g) if by_layer else None)


def answer(g: CodeGraph, questions: DataFrame, k: int = 10, by_layer: bool = False) -> DataFrame:
    """V8: rows (query_id, context, refs): what the recalled methods call and are called by, within two calls. Questions that recall nothing have no row."""
    hits = save(recall(g, questions, k, by_layer).select("query_id", "rank", F.col("id").alias("node")), "hits")
    return around_hits(g, hits)


def around_hits(g: CodeGraph, hits: DataFrame) -> DataFrame:
    """Rows (query_id, context, refs) of the methods ``hits`` (query_id, rank, node), with what lies two calls around each."""
    start = hits.select(F.col("node").alias("origin"), "node").distinct()
    return vectors.context(hits, traverse.around(traverse.keyed(g.known), start, HOPS, vectors.LINES))


def trace(g: CodeGraph, entries: DataFrame, hops: int = TRACE_HOPS) -> DataFrame:
    """V9: rows (origin, n, line): of each entry (origin, node) the calls that lead down from it, within six, nearest first.

    A line is the call by which a method is first reached, its depth and its type.
    """
    found = traverse.reach(traverse.keyed(g.known), entries, hops)
    line = F.concat(F.lit("["), F.col("depth").cast("string"), F.lit("] "), "via", F.lit(" -> "), "node", F.lit(" ("), "type", F.lit(")"))
    n = F.row_number().over(Window.partitionBy("origin").orderBy("depth", "node"))  # what one entry reaches
    return found.select("origin", n.alias("n"), line.alias("line"))


def describe(g: CodeGraph, about: str = "ring bolt gear") -> DataFrame:
    """Rows (layer, samples): per layer the methods that a question about it and ``about`` recalls, thirty at the most, with their summaries."""
    groups = layer_groups(g)
    asked = groups.select(F.col("group").alias("query_id"), "group", F.concat("group", F.lit(f" {about}")).alias("text")).distinct()
    texts = method_texts(g)
    found = lexical.TextIndex(texts).search(asked, SAMPLES, groups).join(texts, "id")
    line = F.concat(F.lit("- "), "id", F.lit(": "), "text")
    return found.groupBy(F.col("query_id").alias("layer")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("samples"))
