"""Shared helpers: tables, intermediate results in the shared folder, word rules."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share, ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (unit tests), a local
    temporary folder stands in for it; a cluster without one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/kelpgraph-{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a re-read, not a recomputation. The
    tables stay until ``clear``, since results that read them are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that weren't written yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def released_shuffles(spark: SparkSession):
    """Let Spark drop a query's shuffle files as soon as that query has been written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(doc_id) -> F.Column:
    """True on the fifth of the documents that no model may learn labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ascii_lower(text) -> F.Column:
    """Lower-case A-Z only, as the contracts ask; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text) -> F.Column:
    """The words of ``text`` in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def salted(rows: DataFrame, counted: DataFrame, keys: list[str], by: list[str], n: str, shards: int = 64, share: int = 10_000, least: int = 200_000) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``keys`` and its new keys, such that no key's rows all meet in one task.

    ``counted`` has one row per key, with ``n``, how many of ``rows`` it has at most. Keys
    with more than ``least`` rows and a ``share``-th of all are hot. They are fewer than
    ``share``, so they are broadcast; their rows get one of ``shards`` salts, by the hash
    of the columns ``by`` (so that a task that is run again salts alike), and their one
    row in ``counted`` is repeated for each salt. Without hot keys nothing changes.
    """
    most = max((counted.agg(F.sum(n)).first()[0] or 0) // share, least)
    hot = counted.where(F.col(n) > most).select(*keys, F.lit(True).alias("__hot"))
    if not hot.limit(1).count():
        return rows, counted, keys
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int")).otherwise(0)).drop("__hot")
    salts = F.when(F.col(n) > most, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.lit(0)))
    return spread, counted.withColumn("__salt", F.explode(salts)), [*keys, "__salt"]
