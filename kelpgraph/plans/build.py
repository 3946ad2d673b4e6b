"""The build: a source tree becomes the tables of a code graph, in full or incrementally."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, naming
from ..operators import extract, inference, linking
from ..sources import files as file_ops
from ..sources.tables import save
from ..streaming.incremental import relink
from .codegraph import CodeGraph

HASHES = "path string, sha256 string"


def setting(name: str, default: int) -> int:
    """A whole number from the environment; the default where there's none."""
    try:
        return int(os.environ.get(name, ""))
    except ValueError:
        return default


def switched_on(name: str, default: bool = False) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


#: The stored tables of a graph; methods, raw_calls and code keep the path they were read from.
STORED = {
    "classes": "name string, file_path string, layer string, is_mapper boolean, is_service boolean",
    "methods": "name string, class_name string, param_count int, file_path string",
    "raw_calls": "caller string, caller_class string, callee string, callee_class string, arg_count int, type string, file_path string",
    "code": "name string, class_name string, param_count int, return_type string, start int, end int, code string, file_path string",
}


def tables_of(sources: DataFrame, rules: dict | None = None) -> dict[str, DataFrame]:
    """classes, methods, raw_calls and code of sources (path, content); every row depends on its own file alone."""
    parsed = extract.parse(sources)
    flags = extract.annotated_classes(sources, rules)
    found = parsed["classes"].join(flags, ["path", "class_name"], "left")
    no, path = F.lit(False), F.col("path").alias("file_path")
    return {
        "classes": found.select(F.col("class_name").alias("name"), path, naming.layer(F.col("path")).alias("layer"), F.coalesce("is_mapper", no).alias("is_mapper"), F.coalesce("is_service", no).alias("is_service")).distinct(),
        "methods": parsed["methods"].select("name", "class_name", "param_count", path).distinct(),
        "raw_calls": parsed["calls"].select("caller", "caller_class", "callee", "callee_class", "arg_count", "type", path),
        "code": parsed["methods"].select("name", "class_name", "param_count", "return_type", "start", "end", "code", path),
    }


def _graph(tables: dict[str, DataFrame], inferred: DataFrame | None = None) -> CodeGraph:
    return CodeGraph(tables["classes"], tables["methods"].drop("file_path").distinct(), tables["raw_calls"].drop("file_path"), inferred)


def graph_of(sources: DataFrame, rules: dict | None = None) -> CodeGraph:
    """The graph of sources (path, content)."""
    return _graph(tables_of(sources, rules))


def build(spark: SparkSession, source_dir: str, out_dir: str, incremental: bool = False, infer: bool = True, rules: dict | None = None) -> DataFrame:
    """``build_from`` the Java files below ``source_dir``."""
    return build_from(save(file_ops.scan(spark, source_dir), "scan"), out_dir, incremental, infer, rules)


def build_from(sources: DataFrame, out_dir: str, incremental: bool = False, infer: bool = True, rules: dict | None = None) -> DataFrame:
    """Write the graph of ``sources`` (path, content, sha256) below ``out_dir``; returns the changed paths.

    Its tables are classes, methods, raw_calls, code (the methods' text and offsets), calls and inferred.

    An incremental run parses the files that are new or changed, keeps the rows of the
    unchanged ones, drops those of removed files, and links anew only the callers that
    name a class of the changed files; the result equals a full run's. If nothing
    changed it writes nothing. The hashes are written last, so a run that failed is
    repeated. Every run writes a new version and then says which one counts.
    """
    spark = sources.sparkSession
    before = file_ops.load_or_empty(spark, f"{out_dir}/hashes", HASHES) if incremental else spark.createDataFrame([], HASHES)
    changed = save(file_ops.delta(sources, before), "changed")
    if incremental and not changed.limit(1).count():
        return changed
    last = file_ops.load_or_empty(spark, f"{out_dir}/current", "version string").first() if incremental else None
    version = uuid.uuid4().hex

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{out_dir}/{version}/{name}")
        return spark.read.parquet(f"{out_dir}/{version}/{name}")

    if last is None:
        stored = {n: write(t, n) for n, t in tables_of(sources, rules).items()}
        calls = write(linking.edges(linking.link(_graph(stored).raw_calls, _graph(stored).methods)), "calls")
    else:
        old = {n: spark.read.schema(s).parquet(f"{out_dir}/{last['version']}/{n}") for n, s in STORED.items()}
        gone = changed.select(F.col("path").alias("file_path"))
        new = tables_of(sources.join(changed.where("status <> 'removed'").select("path"), "path", "left_semi"), rules)
        stored = {n: write(old[n].join(gone, "file_path", "left_anti").select(*new[n].columns).unionByName(new[n]), n) for n in STORED}
        touched = old["classes"].join(gone, "file_path", "left_semi").select(F.col("name").alias("class_name")).union(stored["classes"].join(gone, "file_path", "left_semi").select("name"))
        g = _graph(stored)
        calls = write(relink(spark.read.parquet(f"{out_dir}/{last['version']}/calls"), g.raw_calls, g.methods, touched.distinct()), "calls")
    if infer:
        g = _graph(stored)
        unknown = calls.where("type = 'unknown'").select("caller", "caller_class", "callee")
        write(inference.infer(unknown, g.methods, g.classes, (rules or {}).get("mapper_proxy_confidence", fixed.MAPPER_CONFIDENCE)), "inferred")
    spark.createDataFrame([(version,)], "version string").write.mode("overwrite").parquet(f"{out_dir}/current")
    sources.select("path", "sha256").write.mode("overwrite").parquet(f"{out_dir}/hashes")
    return changed


def load(spark: SparkSession, out_dir: str) -> CodeGraph:
    """The stored graph; inferred edges are among its calls, in place of the unknown ones they resolve."""
    version = spark.read.parquet(f"{out_dir}/current").first()["version"]
    schema = "caller string, caller_class string, callee string, callee_class string, reason string, confidence double"
    inferred = file_ops.load_or_empty(spark, f"{out_dir}/{version}/inferred", schema)
    return _graph({n: spark.read.schema(s).parquet(f"{out_dir}/{version}/{n}") for n, s in STORED.items()}, inferred)
