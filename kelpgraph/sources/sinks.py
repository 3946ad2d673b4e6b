"""Upserts and deletes of the graph's tables, and ordered text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: that of the greatest ``order``. Aggregates before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new``, which replace those of the same key."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_files(nodes: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """K6: nodes of the files ``paths`` (path) gone; paths are compared with forward slashes."""
    gone = paths.select(F.translate("path", "\\", "/").alias("__gone")).distinct()
    return nodes.join(gone, F.translate(F.col(column), "\\", "/") == F.col("__gone"), "left_anti")


def delete_edges(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges whose caller, and callee unless unknown, still are among ``methods`` (name, class_name)."""
    have = methods.select("name", "class_name").distinct()
    caller = have.select(F.col("name").alias("caller"), F.col("class_name").alias("caller_class"))
    callee = have.select(F.col("name").alias("callee"), F.col("class_name").alias("callee_class"))
    known = edges.where("callee_class is not null").join(callee, ["callee", "callee_class"], "left_semi")
    return known.unionByName(edges.where("callee_class is null")).join(caller, ["caller", "caller_class"], "left_semi")


def belongs_to(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """K7: rows (name, class_name, file_path) for methods whose class is defined."""
    c = classes.select(F.col("name").alias("class_name"), "file_path")
    return methods.select("name", "class_name").distinct().join(c, "class_name").select("name", "class_name", "file_path")


def write_ordered(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """A document of any size as text files: its lines in the order of ``order`` are those of the part files, in the order of their names.

    Lines are dealt by ranges of their place and sorted where they lie; no task has
    the whole document. A line may hold line breaks.
    """
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode("overwrite").text(path)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Rows (n, line): the lines that ``write_ordered`` wrote, numbered from 1."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("part"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("i", "line"))
    counts = files.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.orderBy("part")) - F.col("c"))  # one row a file
    return files.join(before, "part").select((F.col("before") + F.col("i") + 1).alias("n"), "line")
