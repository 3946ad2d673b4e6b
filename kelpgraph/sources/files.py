"""Source trees, content hashes and the difference of two states."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def scan(spark: SparkSession, path: str, suffix: str = ".java") -> DataFrame:
    """Path and content of every file below ``path`` with the suffix, but for excluded directories.

    Bytes that aren't UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    parts = F.split("path", "/")
    kept = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, fixed.EXCLUDED_DIRS))))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("sha256"))


def kept_paths(paths: DataFrame, column: str, suffix: str) -> DataFrame:
    """S1's predicate alone, for tables that already list paths."""
    parts = F.split(F.col(column), "/")
    outside = ~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, fixed.EXCLUDED_DIRS)))
    return paths.where(F.col(column).endswith(suffix) & outside)


def hashed(files: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of the content."""
    return files.withColumn("sha256", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))


def load_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where there's none that can be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows (path, status) for new, changed and removed paths of two tables (path, sha256)."""
    both = current.select("path", F.col("sha256").alias("now")).join(previous.select("path", F.col("sha256").alias("before")), "path", "full_outer")
    status = F.when(F.col("now").isNull(), "removed").when(F.col("before").isNull(), "new").when(F.col("now") != F.col("before"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def load_rules(spark: SparkSession, path: str) -> dict:
    """Extraction rules of a JSON file (injection_annotations, bean_annotations, mapper_annotations, mapper_proxy_confidence); {} where none can be read."""
    kinds = ("injection_annotations", "bean_annotations", "mapper_annotations")
    schema = ", ".join(f"{k} array<string>" for k in kinds) + ", mapper_proxy_confidence double"
    try:
        found = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).first()
    except AnalysisException:
        return {}
    return {k: v for k, v in found.asDict().items() if v is not None} if found is not None else {}
