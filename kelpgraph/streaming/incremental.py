"""Incremental runs: upserts from a stream of files, and re-linking after a change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking
from ..sources import sinks
from ..sources.tables import shared_dir


def stream_hashes(spark: SparkSession, path: str, pattern: str, key: str, content: str, state: str | None = None) -> DataFrame:
    """A table (key, sha256) kept by a file stream: each batch of new files is upserted, and what has been read stays read.

    ``pattern`` says which files to watch, ``path`` whose schema they have. Runs over
    what is there and stops. ``state`` is the folder of the table's versions and of
    the stream's checkpoint: a later run, or one after a crash, with the same folder
    goes on from there (without it every run starts anew). Of the rows of one key the
    one of the latest batch counts, of those in one batch the one of the greatest
    hash. Each batch writes a version of its own, and versions are never changed: the
    latest is the one of the greatest number that was written to its end, so that a
    crash at any time leaves the state before or behind the batch. A batch that is
    repeated finds itself done.
    """
    base = state or f"{shared_dir(spark)}/hashes-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema

    def latest() -> int:
        found = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/v*/_SUCCESS")
        done = found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(found)
        return max((int(f.getPath().getParent().getName()[1:]) for f in done or ()), default=-1)

    def version(number: int) -> DataFrame:
        return spark.read.parquet(f"{base}/v{number}")

    def upsert(batch: DataFrame, number: int) -> None:
        before = latest()
        if before >= number:
            return
        new = batch.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("sha256")).groupBy(key).agg(F.max("sha256").alias("sha256"))
        now = sinks.upsert(version(before), new, [key]) if before >= 0 else new
        now.write.mode("overwrite").parquet(f"{base}/v{number}")  # overwrites only what was left unfinished

    stream = spark.readStream.schema(schema).parquet(pattern).writeStream.foreachBatch(upsert)
    stream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = latest()
    if last < 0:
        return spark.read.schema(schema).parquet(path).limit(0).select(key, F.lit("").alias("sha256"))
    return version(last)


def relink(stored: DataFrame, raw: DataFrame, methods: DataFrame, changed: DataFrame) -> DataFrame:
    """The edge table after the classes ``changed`` (class_name) were read anew: equal to linking everything anew.

    Edges out of changed classes are replaced, and so are the edges of every caller
    that names a changed class, since a changed signature may turn those into other
    edges. Nothing else is linked again.
    """
    gone = changed.select(F.col("class_name").alias("caller_class")).distinct()
    touched = raw.join(gone.withColumnRenamed("caller_class", "callee_class"), "callee_class", "left_semi").select("caller_class", "caller")
    affected = touched.union(raw.join(gone, "caller_class", "left_semi").select("caller_class", "caller")).distinct()
    kept = stored.join(affected, ["caller_class", "caller"], "left_anti").join(gone, "caller_class", "left_anti")
    fresh = linking.edges(linking.link(raw.join(affected, ["caller_class", "caller"], "left_semi"), methods))
    return kept.select(*stored.columns).unionByName(fresh.select(*stored.columns))
