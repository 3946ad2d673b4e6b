"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by scanning flat token files."""
    from .op1_tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings removed from every document."""
    from .op2_repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their near-duplicate components."""
    from .op9_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose five-word shingles a document contains to 80 % or more."""
    from .op10_decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .op3_html import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    from .op4_quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    from .op5_mix import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    from .op6_pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    from .op7_language import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 20, among all."""
    from .op8_topk import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 10)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents and every document's proof."""
    from .op11_merkle import prove_all

    return prove_all(table(spark, sf_dir, "documents"))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on every document."""
    from .op12_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    from .op13_spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


OP8_SQL = """
WITH pair AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (v.embedding[i] > 0) AS INT))) AS INT) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance
FROM pair QUALIFY rank <= 10
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
    FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap / weight <= level THEN cap ELSE weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level) END AS target FROM l),
b AS (SELECT *, CAST(least(3, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END) AS BIGINT) AS base FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS missing,
    sum(size) OVER (PARTITION BY d.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      - sum(size) OVER (PARTITION BY d.source, u) / 2.0 AS middle FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, base + CASE WHEN base < 3 AND middle <= missing THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CASE WHEN size = 0 THEN 0 ELSE copies END AS copies FROM e
"""

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(len(w), 5) AS width, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i : i + least(len(w), 5) - 1], ' '))) AS x FROM b WHERE len(w) > 0),
widths AS (SELECT DISTINCT width FROM item),
doc AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS x FROM d, widths WHERE len(w) >= width),
size AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM doc JOIN item USING (width, x) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(n_item) >= 0.8
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_counts, op2_repeats, op3_main_text, op4_quality, op5_mix, op6_pii, op7_language, op8_topk, op9_simhash, op10_decontaminate, op11_merkle, op12_rules, op13_spelling, pipeline)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_mix": OP5_SQL, "op8_topk": OP8_SQL, "op10_decontaminate": OP10_SQL}
