"""Command line: build a graph from sources, then ask it.

    python -m kelpgraph build SOURCES GRAPH [--incremental]
    python -m kelpgraph report GRAPH [--chains FILE] [--json FOLDER]
    python -m kelpgraph downstream|upstream GRAPH Class.method [--depth N]
    python -m kelpgraph path GRAPH Class.method Class.method
    python -m kelpgraph search GRAPH TEXT
    python -m kelpgraph ask GRAPH QUESTION [--layer NAME] [--top N]
    python -m kelpgraph trace GRAPH Class.method
    python -m kelpgraph describe GRAPH LAYER
    python -m kelpgraph docs|mermaid|plantuml|json GRAPH FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chains, quality, rag, traverse, trees
from .plans import build as plans
from .sources.sinks import write_ordered


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kelpgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["build", "report", "downstream", "upstream", "path", "search", "ask", "trace", "describe", "docs", "mermaid", "plantuml", "json"])
    p.add_argument("args", nargs="+")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("--depth", type=int, default=plans.setting("KELPGRAPH_DEPTH", 10))
    p.add_argument("--layer")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--chains")
    p.add_argument("--json")
    o = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if o.command == "build":
        plans.build(spark, o.args[0], o.args[1], o.incremental).groupBy("status").count().show()
        return
    g = plans.load(spark, o.args[0])
    rest = o.args[1:]
    if o.command == "report":
        wanted = chains.load(spark, o.chains) if o.chains else spark.createDataFrame([], f"name string, hops {chains.HOPS}")
        found = quality.metrics(g.classes, g.nodes, g.calls, wanted, o.depth)
        if o.json:
            found.write.mode("overwrite").json(o.json)
        found.show(50, truncate=False)
    elif o.command in ("downstream", "upstream"):
        start = spark.createDataFrame([(rest[0], rest[0])], "origin string, node string")
        traverse.reach(traverse.keyed(g.known), start, o.depth, up=o.command == "upstream").orderBy("depth", "node").show(1000, truncate=False)
    elif o.command == "path":
        start = spark.createDataFrame([(rest[0], rest[0])], "origin string, node string")
        traverse.shortest_path(traverse.keyed(g.known), start, rest[1], o.depth).show(truncate=False)
    elif o.command == "search":
        trees.search_classes(g.classes, g.nodes, rest[0]).orderBy("name").show(100, truncate=False)
    elif o.command == "ask":
        asked = spark.createDataFrame([(1, rest[0], o.layer)], "query_id int, text string, group string")
        rag.answer(g, asked, o.top, by_layer=o.layer is not None).show(truncate=False)
    elif o.command == "trace":
        rag.trace(g, spark.createDataFrame([(rest[0], rest[0])], "origin string, node string")).orderBy("n").select("line").show(1000, truncate=False)
    elif o.command == "describe":
        rag.describe(g).where(F.col("layer") == rest[0]).show(truncate=False)
    elif o.command == "docs":
        write_ordered(trees.architecture_lines(g.classes, g.nodes), rest[0], ["a", "b", "c"])
    elif o.command == "json":
        write_ordered(trees.document_lines(g.classes, g.nodes), rest[0], ["key"])
    else:
        text = {"mermaid": lambda: trees.mermaid_layers(g.classes), "plantuml": lambda: trees.plantuml_layers(g.classes)}[o.command]()
        text.select("text").write.mode("overwrite").text(rest[0])


if __name__ == "__main__":
    main()
