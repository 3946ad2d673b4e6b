"""Operator 1: token counts of documents in flat token files by a separator scan.

A flat token file is a sequence of little-endian token identifiers without any
index; every document ends with the end-of-document identifier. Files are read
in fixed blocks. Each block is searched for separators with one vector
comparison, independently of all others, and is summed up in four numbers: its
tokens, its separators, the tokens before the first and those after the last.
A prefix scan over the blocks of a file (within groups of ``GROUP`` blocks, then
over the groups) gives each block the number of documents before it and the
length of the document that is open where it begins, which is all that's needed
to stitch documents across block boundaries.
"""

from __future__ import annotations

import base64
import os.path
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import released_shuffles, save, shared_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
WIDTH = 2
BLOCK = 1 << 16
GROUP = 1024
#: The split pattern that this vocabulary was made with; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space (of the split pattern's kind) that the pattern's recursion shouldn't see.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(encoder, text: str) -> list[int]:
    """The tokens of ``text``; long runs of white space are cut out where the pattern cuts them anyway.

    The pattern makes one piece of a run but for its last character, or of the whole
    run at the end of the text, so both sides can be encoded apart.
    """
    out: list[int] = []
    at = 0
    for run in _BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += encoder.encode_ordinary(text[at : run.start()])
        out += encoder._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoder.encode_ordinary(text[at:] if at else text)


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, eod: int = END_OF_DOCUMENT, width: int = WIDTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` as flat token streams, one a partition: (blocks, manifest).

    blocks: file, block, payload (``block`` identifiers, the last one fewer).
    manifest: file, first, ids: the doc_ids in order, ``first`` being the position
    of the first of them; it says whose documents these are, not where they lie.
    Null texts are empty documents. Spark sends the vocabulary file ``tokenizer``,
    which only the driver needs to have, to the executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    vocabulary = os.path.basename(tokenizer)
    kind = np.dtype(f"<u{width}")

    def rows(batches):
        encoder = _encoder(SparkFiles.get(vocabulary))
        file, at, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        n = 0

        def out(payloads, at, first, ids):
            pay = [*payloads, *([None] if ids is not None else [])]
            return pa.RecordBatch.from_arrays([
                pa.array([file] * len(pay), pa.int64()), pa.array([*range(at, at + len(payloads)), *([-1] if ids is not None else [])], pa.int64()), pa.array(pay, pa.binary()),
                pa.array([None] * len(payloads) + ([first] if ids is not None else []), pa.int64()), pa.array([None] * len(payloads) + ([ids] if ids is not None else []), pa.list_(pa.int64())),
            ], names=["file", "block", "payload", "first", "ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            payloads = []
            for text in batch.column(1).to_pylist():
                held.append(np.array([*encode(encoder, text or ""), eod], kind))
                n += len(held[-1])
                if n >= block:
                    flat = np.concatenate(held)
                    whole = n // block * block
                    payloads += [flat[i : i + block].tobytes() for i in range(0, whole, block)]
                    held, n = [flat[whole:]], n - whole
            yield out(payloads, at, first, ids)
            at, first = at + len(payloads), first + len(ids)
        if n:
            yield out([np.concatenate(held).tobytes()], at, first, None)

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/op1-tokens-{uuid.uuid4().hex}"
    schema = "file long, block long, payload binary, first long, ids array<long>"
    with released_shuffles(spark):
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text")).mapInArrow(rows, schema).write.option("compression", "zstd").parquet(path)
    both = spark.read.schema(schema).parquet(path)
    return both.where("block >= 0").select("file", "block", "payload"), both.where("block < 0").select("file", "first", "ids")


def read_flat_files(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, payload) of the flat token files that ``path`` matches; file is the path.

    A file passes through one task before it is cut, so files should stay well
    below the memory of a task; tokenizers usually write shards of that kind.
    """
    size = block * width
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.length("content").alias("n"))
    cut = files.where("n > 0").select("file", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("block"))
    return cut.select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("payload"))




def _searched(blocks: DataFrame, eod: int, width: int) -> DataFrame:
    """The four numbers of each block, and the lengths of the documents that lie inside it."""
    kind = np.dtype(f"<u{width}")

    def rows(batches):
        for batch in batches:
            n, seps, head, tail, inner = [], [], [], [], []
            for payload in batch.column(2):
                tokens = np.frombuffer(payload.as_buffer(), kind)
                at = np.flatnonzero(tokens == eod)
                n.append(len(tokens))
                seps.append(len(at))
                head.append(int(at[0]) if len(at) else len(tokens))
                tail.append(len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens))
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, seps, head, tail)), pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "n", "seps", "head", "tail", "inner"])

    schema = f"file {dict(blocks.dtypes)['file']}, block long, n long, seps long, head long, tail long, inner array<long>"
    return blocks.select("file", "block", "payload").mapInArrow(rows, schema)


def separator_scan(blocks: DataFrame, eod: int = END_OF_DOCUMENT, width: int = WIDTH) -> DataFrame:
    """Rows (file, position, n_tokens, ended) for every document of the files of ``blocks``.

    position counts a file's documents from 0; separators aren't counted as
    tokens; adjacent separators enclose an empty document. A last document
    without a separator has ended = false. Empty files have no rows.
    """
    found = save(_searched(blocks, eod, width).withColumn("part", F.floor(F.col("block") / GROUP)), "op1-blocks")
    # Inside a group: tokens and separators before the block, and where the last document before it ended.
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    local = found.select("file", "part", "block", "n", "seps", "head", "tail", "inner", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("tokens"), F.coalesce(F.sum("seps").over(inside), F.lit(0)).alias("docs"), F.sum("n").over(upto).alias("through"))
    local = local.withColumn("end", F.when(F.col("seps") > 0, F.col("through") - F.col("tail"))).withColumn("ended", F.max("end").over(inside))
    groups = local.groupBy("file", "part").agg(F.sum("n").alias("g_n"), F.sum("seps").alias("g_seps"), F.max("end").alias("g_end"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "part", "g_end", "g_n", F.coalesce(F.sum("g_n").over(before), F.lit(0)).alias("g_tokens"), F.coalesce(F.sum("g_seps").over(before), F.lit(0)).alias("g_docs"))
    groups = groups.withColumn("g_ended", F.coalesce(F.max(F.col("g_tokens") + F.col("g_end")).over(before), F.lit(0)))
    placed = local.join(groups.drop("g_end", "g_n"), ["file", "part"])
    open_since = F.coalesce(F.col("g_tokens") + F.col("ended"), F.col("g_ended"))
    carried = F.col("g_tokens") + F.col("tokens") - open_since
    lengths = F.concat(F.array(carried + F.col("head")), "inner")
    closed = placed.where("seps > 0").select("file", (F.col("g_docs") + F.col("docs")).alias("base"), F.posexplode(lengths).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("base") + F.col("i")).alias("position"), "n_tokens", F.lit(True).alias("ended"))
    whole = groups.groupBy("file").agg(F.sum("g_n").alias("n"), F.max(F.col("g_tokens") + F.col("g_end")).alias("end"))
    count = found.groupBy("file").agg(F.sum("seps").alias("position"))
    rest = whole.join(count, "file").select("file", "position", (F.col("n") - F.coalesce("end", F.lit(0))).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return closed.union(rest)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, eod: int = END_OF_DOCUMENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and n_tokens, by way of flat token files.

    Null and empty texts have 0 tokens; other columns are ignored; repeated rows
    are counted each; an empty table has no rows. Texts are bounded by a task's
    memory alone, whatever they repeat.
    """
    blocks, manifest = tokenize(docs, tokenizer, eod)
    counted = separator_scan(blocks, eod)
    owners = manifest.select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("position"), "doc_id")
    return owners.join(counted.where("ended"), ["file", "position"]).select("doc_id", "n_tokens")
