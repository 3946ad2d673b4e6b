"""Trees, diagrams and documents as flat rows and texts.

A diagram drawn as one text is made in one task, and its size is that of the part of
the graph it draws. The functions whose names end in ``_lines`` give the same document
as rows with a place and a line, for ``sinks.write_ordered``, whatever its size; so
nested JSON needs no nested value either: a node's opening and closing lines stand
before and behind those of what is in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, naming
from .taxonomy import layered


def _lines(column: str, order: list[str]):
    """The lines of a group in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("line")))), lambda x: x["line"]), "\n")


def layer_tree(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (layer, priority, class_name, methods, n_methods) of classes in a layer; methods comma-joined in order."""
    per = nodes.groupBy("class_name").agg(F.sort_array(F.collect_set("name")).alias("m")).select("class_name", F.array_join("m", ",").alias("methods"), F.size("m").cast("long").alias("n_methods"))
    known = layered(classes).where("layer <> 'other'").select("layer", "priority", F.col("name").alias("class_name"))
    return known.join(per, "class_name", "left").select("layer", "priority", "class_name", F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("n_methods", F.lit(0)).alias("n_methods"))


def package_path(path):
    """H2: the layers and packages a path names: build directories dropped, a layer restarts the packages after it."""
    parts = F.filter(F.split(F.regexp_replace(F.translate(path, "\\", "/"), r"\.java$", ""), "/"), lambda x: ~x.isin("", "src", "main", "java"))
    layers = F.array(*map(F.lit, fixed.LAYER_PRIORITY))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("layers"), empty.alias("rest"))
    step = lambda a, x: F.when(F.array_contains(layers, F.lower(x)), F.struct(F.array_append(a["layers"], x).alias("layers"), empty.alias("rest"))).otherwise(F.struct(a["layers"].alias("layers"), F.array_append(a["rest"], x).alias("rest")))
    return F.aggregate(parts, start, step, lambda a: F.concat(a["layers"], a["rest"]))


def package_tree(classes: DataFrame) -> DataFrame:
    """Rows (path, parent, name, kind, classes): every prefix of every class's package path."""
    p = F.col("p")
    paths = classes.select(package_path(F.col("file_path")).alias("p")).where(F.size("p") > 0)
    prefixes = paths.select(F.size(p).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.slice(p, F.lit(1), i))).alias("p"))
    kind = F.max(F.when(F.size("p") == F.col("n"), "class").otherwise("package"))
    rows = prefixes.groupBy("p").agg(F.count("*").alias("classes"), kind.alias("kind"))
    return rows.select(F.array_join("p", "/").alias("path"), F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("parent"), F.element_at("p", -1).alias("name"), "kind", "classes")


def mermaid_layers(classes: DataFrame) -> DataFrame:
    """One text; a subgraph per layer, and between neighbouring layers an edge from first class to first class."""
    per = layered(classes).where("layer <> 'other'").groupBy("layer", "priority").agg(F.sort_array(F.collect_list("name")).alias("names"))
    ident = lambda x: F.regexp_replace(x, r"[^A-Za-z0-9_]", "_")
    body = F.concat(F.lit("  subgraph "), "layer", F.lit("\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("    "), ident(x), F.lit('["'), x, F.lit('"]'))), "\n"), F.lit("\n  end"))
    first = ident(F.get("names", 0))
    after = F.lead(first).over(Window.orderBy("priority", "layer"))  # one row a layer, at most 16
    rows = per.select("priority", "layer", body.alias("body"), F.concat(F.lit("  "), first, F.lit(" --> "), after).alias("edge"))
    return rows.agg(F.concat(F.lit("graph TD\n"), _lines("body", ["priority", "layer"]), F.lit("\n"), _lines("edge", ["priority", "layer"])).alias("text"))


def plantuml_layers(classes: DataFrame) -> DataFrame:
    """One text; a package per layer, and every class of a layer to every class of the next."""
    rows = layered(classes).where("layer <> 'other'").select("layer", "priority", "name")
    order = rows.select("layer", "priority").distinct().withColumn("n", F.row_number().over(Window.orderBy("priority", "layer")))
    placed = rows.join(order, ["layer", "priority"])
    box = placed.groupBy("n", "layer").agg(F.array_join(F.transform(F.sort_array(F.collect_list("name")), lambda x: F.concat(F.lit("  class "), F.regexp_replace(x, r"[^A-Za-z0-9_]", "_"))), "\n").alias("c"))
    a, b = placed.select("n", F.col("name").alias("a")), placed.select((F.col("n") - 1).alias("n"), F.col("name").alias("b"))
    line = F.concat(F.regexp_replace("a", r"[^A-Za-z0-9_]", "_"), F.lit(" --> "), F.regexp_replace("b", r"[^A-Za-z0-9_]", "_"))
    lines = box.select(F.lit(0).alias("k"), F.col("n").alias("x"), F.lit("").alias("y"), F.concat(F.lit('package "'), "layer", F.lit('" {\n'), "c", F.lit("\n}")).alias("line"))
    lines = lines.unionByName(a.join(b, "n").select(F.lit(1).alias("k"), F.col("n").alias("x"), line.alias("y"), line.alias("line")))
    return lines.agg(F.concat(F.lit("@startuml\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y", "line"))), lambda s: s["line"]), "\n"), F.lit("\n@enduml")).alias("text"))


def mermaid_calls(tree: DataFrame) -> DataFrame:
    """A text per root: the tree's edges, dashed where they aren't internal."""
    ident = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    edge = tree.where("depth > 0").select("root", ident(F.element_at("path", -2)).alias("a"), ident(F.col("node")).alias("b"), "type").distinct()
    line = F.concat(F.lit("  "), "a", F.when(F.col("type") == "internal", " --> ").otherwise(" -.-> "), "b")
    return edge.withColumn("line", line).groupBy("root").agg(F.concat(F.lit("graph TD\n"), _lines("line", ["a", "b", "type"])).alias("text"))


def _layer_lines(classes: DataFrame, nodes: DataFrame, preview: int) -> DataFrame:
    """Rows (layer, priority, class_name, line) of the classes of every layer."""
    per = nodes.groupBy("class_name").agg(F.sort_array(F.collect_set("name")).alias("m"))
    more = F.when(F.size("m") > preview, F.concat(F.lit(" (+"), (F.size("m") - preview).cast("string"), F.lit(")"))).otherwise("")
    known = layered(classes).select("layer", "priority", F.col("name").alias("class_name")).join(per, "class_name", "left")
    line = F.concat(F.lit("- "), "class_name", F.lit(": "), F.coalesce(F.array_join(F.slice("m", 1, preview), ", "), F.lit("")), F.coalesce(more, F.lit("")))
    return known.withColumn("line", line)


def _layer_head() -> F.Column:
    return F.concat(F.lit("## "), "layer", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))


def layer_docs(classes: DataFrame, nodes: DataFrame, preview: int = 8) -> DataFrame:
    """A Markdown text per layer: its classes with at most ``preview`` methods each, and how many more."""
    docs = _layer_lines(classes, nodes, preview).groupBy("layer", "priority").agg(F.count("*").alias("n"), _lines("line", ["class_name"]).alias("body"))
    return docs.select("layer", "priority", F.concat(_layer_head(), F.lit("\n"), "body").alias("text"))


def architecture_doc(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The layers' texts one after the other."""
    return layer_docs(classes, nodes).agg(F.concat(F.lit("# Architecture\n"), _lines("text", ["priority", "layer"])).alias("text"))


def architecture_lines(classes: DataFrame, nodes: DataFrame, preview: int = 8) -> DataFrame:
    """The lines of ``architecture_doc``: rows (a, b, c, line), to be ordered by a, b and c."""
    body = _layer_lines(classes, nodes, preview).select(F.col("priority").alias("a"), F.col("layer").alias("b"), F.concat(F.lit("-"), "class_name").alias("c"), "line")
    heads = layered(classes).groupBy("layer", "priority").agg(F.count("*").alias("n")).select(F.col("priority").alias("a"), F.col("layer").alias("b"), F.lit("").alias("c"), _layer_head().alias("line"))
    title = classes.sparkSession.range(1).select(F.lit(-1).alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.lit("# Architecture").alias("line"))
    return title.unionByName(heads).unionByName(body)


_LAST = "\uffff"  # behind every name


def document_lines(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Packages, classes and their methods as one nested JSON array, however deep: rows (key, line), to be ordered by key.

    A node is {"name", "kind", "children"}; methods have no children. Children of one
    node are in the order of their names, at their classes' first file.
    """
    p = F.col("p")
    paths = classes.select("name", package_path(F.col("file_path")).alias("p")).where(F.size("p") > 0)
    inner = paths.select(F.size(p).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.slice(p, F.lit(1), i))).alias("p"))
    inner = inner.groupBy("p").agg(F.max(F.when(F.size("p") == F.col("n"), "class").otherwise("package")).alias("kind"))
    methods = paths.join(nodes.select(F.col("class_name").alias("name"), F.col("name").alias("m")), "name").select(F.array_append(p, F.col("m")).alias("p"), F.lit("method").alias("kind")).distinct()
    methods = methods.join(inner.select("p"), "p", "left_anti")
    every = inner.unionByName(methods).withColumn("parent", F.slice(p, F.lit(1), F.size(p) - 1))
    first = every.groupBy("parent").agg(F.min("p").alias("first"))  # the others come behind a comma
    told = every.join(first, "parent")
    comma = F.when(p == F.col("first"), "").otherwise(",")
    node = F.to_json(F.struct(F.element_at(p, -1).alias("name"), "kind"))
    opening = F.when(F.col("kind") == "method", node).otherwise(F.concat(F.expr("substring(to_json(struct(element_at(p, -1) AS name, kind)), 1, length(to_json(struct(element_at(p, -1) AS name, kind))) - 1)"), F.lit(',"children":[')))
    rows = told.select(p.alias("key"), F.concat(comma, opening).alias("line"))
    rows = rows.unionByName(inner.select(F.array_append(p, F.lit(_LAST)).alias("key"), F.lit("]}").alias("line")))
    ends = classes.sparkSession.range(1).select(F.explode(F.array(F.struct(F.array().cast("array<string>").alias("key"), F.lit("[").alias("line")), F.struct(F.array(F.lit(_LAST)).alias("key"), F.lit("]").alias("line")))).alias("x"))
    return rows.unionByName(ends.select("x.*"))


def search_classes(classes: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """Classes whose name, or the name of a method, contains the query; case is ignored."""
    q = query.lower()
    hit = nodes.where(F.lower("name").contains(q)).select(F.col("class_name").alias("name")).distinct()
    return classes.where(F.lower("name").contains(q)).select("name").union(classes.join(hit, "name", "left_semi").select("name")).distinct()


def plantuml_calls(tree: DataFrame) -> DataFrame:
    """A text per root: its call tree in pre-order, each node after the edge that leads to it; external ones are pink."""
    ident = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    edge = F.when(F.col("depth") > 0, F.concat(ident(F.element_at("path", -2)), F.lit(" --> "), ident(F.col("node")), F.lit("\n"))).otherwise("")
    colour = F.when(F.col("type") == "external", " #pink").otherwise("")
    node = F.concat(F.lit('class "'), F.element_at(F.split("node", r"\."), -1), F.lit('" as '), ident(F.col("node")), colour)
    rows = tree.select("root", "path", F.concat(edge, node).alias("line"))
    return rows.groupBy("root").agg(F.concat(F.lit("@startuml\n"), _lines("line", ["path"]), F.lit("\n@enduml")).alias("text"))


def package_lines(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Packages inside one another, classes with the number of their methods: rows (key, line), to be ordered by both."""
    per = nodes.groupBy("class_name").agg(F.count_distinct("name").alias("n"))
    p, pad = F.col("p"), lambda n: F.repeat(F.lit("  "), n)
    named = classes.select("name", package_path(F.col("file_path")).alias("p")).where(F.size("p") > 0).join(per.withColumnRenamed("class_name", "name"), "name", "left")
    leaf = named.select(p.alias("key"), F.concat(pad(F.size(p) - 1), F.lit("class "), F.element_at(p, -1), F.lit(" {\n"), pad(F.size(p)), F.lit("+ "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" methods\n"), pad(F.size(p) - 1), F.lit("}")).alias("line"))
    inner = named.select(F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: i < F.size(p)), lambda i: F.slice(p, F.lit(1), i))).alias("p")).distinct()
    opened = inner.select(p.alias("key"), F.concat(pad(F.size(p) - 1), F.lit('package "'), F.element_at(p, -1), F.lit('" {')).alias("line"))
    closed = inner.select(F.array_append(p, F.lit("\uffff")).alias("key"), F.concat(pad(F.size(p) - 1), F.lit("}")).alias("line"))
    return opened.unionByName(leaf).unionByName(closed)


def plantuml_packages(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same as one text."""
    rows = package_lines(classes, nodes)
    return rows.agg(F.concat(F.lit("@startuml\nskinparam packageStyle folder\n"), _lines("line", ["key"]), F.lit("\n@enduml")).alias("text"))


def package_search(classes: DataFrame, nodes: DataFrame, query: str) -> DataFrame:
    """the rows of the package tree that contain the query in their own name, in one below them or in a method of such a class; case is ignored."""
    q = query.lower()
    p = F.col("p")
    by_method = nodes.where(F.lower("name").contains(q)).select(F.col("class_name").alias("name")).distinct().withColumn("hit", F.lit(True))
    paths = classes.select("name", package_path(F.col("file_path")).alias("p")).where(F.size("p") > 0).join(by_method, "name", "left")
    found = paths.select(p, F.coalesce("hit", F.lit(False)).alias("hit"), F.explode(F.sequence(F.lit(1), F.size(p))).alias("n"))
    below = F.col("hit") | F.exists(F.slice(p, F.col("n"), F.size(p)), lambda x: F.lower(x).contains(q))
    return found.where(below).select(F.array_join(F.slice(p, F.lit(1), F.col("n")), "/").alias("path")).distinct()


def layer_nodes(classes: DataFrame) -> DataFrame:
    """The layers that own a class."""
    return layered(classes).groupBy(F.col("layer").alias("name"), "priority").agg(F.count_distinct("name").alias("classes"))


def layer_contains(classes: DataFrame) -> DataFrame:
    """Rows (layer, class_name)."""
    return layered(classes).select("layer", F.col("name").alias("class_name")).distinct()


def package_contains(classes: DataFrame) -> DataFrame:
    """Rows (package, class_name); the package is the path of the tree's directory the class lies in."""
    p = package_path(F.col("file_path"))
    return classes.select(F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/").alias("package"), F.col("name").alias("class_name")).where("package <> ''").distinct()


def package_nodes(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Packages with the classes and methods that lie directly in them."""
    per = nodes.groupBy("class_name").agg(F.count_distinct("name").alias("m"))
    return package_contains(classes).join(per, "class_name", "left").groupBy(F.col("package").alias("name")).agg(F.count("*").alias("class_count"), F.coalesce(F.sum("m"), F.lit(0)).alias("method_count"))


def call_paths(reached: DataFrame) -> DataFrame:
    """Rows (start_method, end_method, depth) of a traversal."""
    return reached.select(F.col("origin").alias("start_method"), F.col("node").alias("end_method"), "depth")


def merged_classes(listed: DataFrame) -> DataFrame:
    """Classes of one name become one, with the union of their methods, each once and in order."""
    return listed.groupBy("class_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))).alias("methods"))


def tree_summary(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per layer and for all layers together (layer null): classes, methods, and the mean number of methods a class."""
    tree = layer_tree(classes, nodes)
    counts = (F.count("*").alias("classes"), F.coalesce(F.sum("n_methods"), F.lit(0)).alias("methods"))
    both = tree.groupBy("layer").agg(*counts).unionByName(tree.agg(*counts).withColumn("layer", F.lit(None).cast("string")))
    return both.select("layer", "classes", "methods", naming.ratio(F.col("methods"), F.col("classes")).alias("mean_methods"))


def write_tree(tree: DataFrame, path: str) -> None:
    """A tree's rows as JSON lines."""
    tree.write.mode("overwrite").json(path)


def read_tree(spark, paths: list[str], schema) -> DataFrame:
    """The rows of the first of ``paths`` that can be read; none, if none can."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return spark.read.schema(schema).json(path)
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)
