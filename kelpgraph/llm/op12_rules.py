"""Operator 12: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hash buckets of token unigrams and bigrams are counted, each
in one pass with map-side combining: that of a trusted target (documents labelled
good) and that of the raw corpus, all documents. A document's score is the mean over
its n-grams of log(target share / raw share) of their buckets, so its length cancels
out, and the rule is deterministic: a document passes if its score isn't below
``THRESHOLD``. The table of ratios has ``BUCKETS`` numbers; it is an uncorrelated
scalar subquery, so documents are scored without a shuffle or a row per n-gram.

A token is a run of letters and digits or a run of other characters; case counts.
Base rules on words, lines and repeated windows come first. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, held_out, save, words

TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
BUCKETS = 1 << 14
#: Nats an n-gram below which a document is left out. Documents like the target lie around
#: 0 at every size of the corpus; what the target hasn't lies below the cut by a multiple of it.
THRESHOLD = -0.25
#: Trusted documents of the fit at the most, about: those of the least hashes of doc_id. Their ids are broadcast.
TRUSTED = 500_000
#: Words of a window, fewest words, and per cent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = r"[#*$%&|<>]"


def _pairs(hashes: Column, apart: int) -> Column:
    """The hash of each element with the one ``apart`` places behind it; empty where there is none."""
    n = F.size(hashes)
    at = F.when(n > apart, F.sequence(F.lit(0), n - apart - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + apart)))


def with_buckets(docs: DataFrame) -> DataFrame:
    """Add ``buckets``, those of the unigrams and bigrams of the column ``text``, repeats included."""
    hashes = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    out = docs.withColumn("__tokens", hashes).withColumn("__grams", F.concat("__tokens", _pairs(F.col("__tokens"), 1)))
    return out.withColumn("buckets", F.transform("__grams", lambda h: h.bitwiseAND(BUCKETS - 1).cast("int"))).drop("__tokens", "__grams")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct doc_id of good, non-toxic rows of ``labels`` outside the held-out fifth, ``TRUSTED`` of them at the most or so."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) <> 1").where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    good = save(good, "op12-trusted")
    share = min(1.0, TRUSTED / max(1, good.count()))
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with ``ratios``, the log of target share by raw share of every bucket, each count raised by one.

    Without a trusted document all are 0.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marked = text.join(F.broadcast(trusted_ids(labels).withColumn("trusted", F.lit(1))), "doc_id", "left")
    # explode_outer: for the plain one Spark adds a filter that computes the buckets again, inside the lambda.
    counts = with_buckets(marked).select("trusted", F.explode_outer("buckets").alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(save(counts, "op12-counts"), "bucket", "left").fillna(0)
    listed = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "target", "raw"))).alias("c"), F.sum("target").alias("t"), F.sum("raw").alias("r"))
    share = lambda n, total: F.ln((n + 1.0) / (total + float(BUCKETS)))
    value = lambda x: share(x["target"], F.col("t")) - share(x["raw"], F.col("r"))
    return save(listed.select(F.transform("c", lambda x: F.when(F.col("t") > 0, value(x)).otherwise(F.lit(0.0))).alias("ratios")), "op12-ratios")


def _repeated(w: Column, h: Column) -> Column:
    """Words covered by windows that occur more than once; ``h`` has the windows' hashes.

    Windows are put in the order of their hashes; one is repeated if it equals, word
    by word, a neighbour in that order.
    """
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def same(s, x, k) -> Column:
        y = F.get(s, k)
        return F.coalesce((x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, F.lit(WINDOW)) == F.slice(w, y["i"] + 1, F.lit(WINDOW))), F.lit(False))

    let = lambda value, use: F.get(F.transform(F.array(value), use), 0)
    found = let(placed, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: same(s, x, k + 1) | (F.when(k > 0, same(s, x, k - 1)).otherwise(False))), lambda x: x["i"])))
    step = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")))["n"]
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(found, step))


def base(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, from the column ``text``."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("__w", words(F.col("text")))
    half = WINDOW // 2
    starts = F.when(F.size("__w") >= half, F.sequence(F.lit(0), F.size("__w") - half)).otherwise(F.array().cast("array<int>"))
    out = out.withColumns({"__h": F.transform(starts, lambda i: F.xxhash64(*(F.get("__w", i + j) for j in range(half)))), "__lines": lines})
    out = out.withColumn("__h", _pairs(F.col("__h"), half))  # of windows
    out = out.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": _repeated(F.col("__w"), F.col("__h")).cast("long"),
    })
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).drop("__w", "__h", "__lines")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (row, doc_id, the base columns, ratio, kept), one per row of ``docs``; ``row`` has all of its columns.

    To be written before it is filtered: Spark would push a filter down below the
    columns it reads and compute these again inside the lambdas.
    """
    text = F.make_valid_utf8(F.coalesce(F.col("text"), F.lit("")))
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    table = ratios(mine, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic"))
    out = with_buckets(base(mine)).withColumn("__ratios", table.scalar())
    total = F.aggregate("buckets", F.lit(0.0), lambda s, b: s + F.get("__ratios", b))
    out = out.withColumn("ratio", F.when(F.size("buckets") > 0, total / F.size("buckets")).otherwise(0.0))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= THRESHOLD)).drop("text", "buckets", "__ratios")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio), one per row of ``docs``.

    ``docs`` has doc_id and text, ``labels`` doc_id, quality and toxic; other columns
    are ignored. A null text counts as an empty one, has no n-gram and the ratio 0,
    and fails the base rules. Repeated rows count, and are judged, each for itself;
    a doc_id with several labels is trusted if one of them says so. In text that isn't
    valid UTF-8, U+FFFD stands for what isn't. ``kept`` is false if the base rules
    fail, else whether ratio >= ``THRESHOLD``.
    """
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
    return save(judged(docs.select("doc_id", "text"), labels).select(*columns), "op12-rules")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all of their columns."""
    return save(judged(docs, labels).select("row", "kept"), "op12-judged").where("kept").select("row.*")
