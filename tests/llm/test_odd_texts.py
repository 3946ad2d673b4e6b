"""Bytes that aren't UTF-8 through every operator and stage, and ties of rows that share doc_id and text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import op1_tokens, op2_repeats, op3_html, op6_pii, op7_language, op9_simhash, op10_decontaminate

BAD = "cast(unhex('6162FF63') AS string)"


@pytest.fixture(scope="module")
def docs(spark):
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = "cast(concat(cast(repeat('the same words again and ', 20) AS binary), unhex('FF'), cast(repeat('and once more of it ', 20) AS binary)) AS string)"
    odd = spark.sql(f"SELECT id AS doc_id, CASE WHEN id < 100002 THEN {BAD} ELSE {long} END AS text, 'en' AS lang, 's' AS source, 4L AS n_chars FROM range(100000, 100004)")
    return good.limit(60).unionByName(odd).cache()


def test_operators(spark, docs):
    n = docs.count()
    enc = op1_tokens._encoder(op1_tokens.TOKENIZER)
    tokens = {r[0]: r[1] for r in op1_tokens.count_tokens(docs).collect()}
    assert len(tokens) == n and tokens[100000] == len(enc.encode_ordinary("ab�c"))
    rows = {r.doc_id: r for r in op2_repeats.remove_repeats(docs).collect()}
    assert rows[100000].n_bytes == 4 and rows[100000].kept_sha256 == hashlib.sha256(b"ab\xffc").hexdigest()
    assert rows[100002].n_removed == rows[100002].n_bytes == 20 * 25 + 1 + 20 * 20
    langs = {r.doc_id: r.lang_pred for r in op7_language.identify(docs).collect()}
    assert len(langs) == n and langs[100000] != "und"
    assert op9_simhash.near_duplicates(docs).count() == n
    assert {r.doc_id for r in op6_pii.find_pii(docs).collect()} == set(tokens)


def test_pages(spark):
    page = "cast(concat(cast('<article><p>a' AS binary), unhex('FF'), cast('b</p></article>' AS binary)) AS string)"
    (row,) = op3_html.extract(spark.sql(f"SELECT 1L AS page_id, {BAD} AS url, {page} AS html")).collect()
    assert (row.text, row.url, row.n_chars) == ("a�b", "ab�c", 3)


def test_stages(spark, docs):
    assert op7_language.keep_identified(docs).columns == docs.columns
    assert 100000 in {r.doc_id for r in op9_simhash.keep_one(docs).collect()}
    assert 100000 in {r.doc_id for r in op10_decontaminate.keep_clean(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert op6_pii.redact(docs).where("doc_id = 100000").select(F.hex("text")).first()[0] == "6162FF63"


@pytest.mark.parametrize("order", [1, -1])
def test_of_rows_with_one_id_and_text_the_same_stays(spark, order):
    rows = [(5, "one two three four five", "en", "s1", 1), (5, "one two three four five", "de", "s2", 2), (5, "one two three four five", None, "s3", 3), (9, None, "en", "x", 0), (9, None, "en", "y", 0)]
    df = spark.createDataFrame(rows[::order], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = sorted(map(tuple, op9_simhash.keep_one(df).collect()))
    assert len(got) == 2 and got == sorted(map(tuple, op9_simhash.keep_one(df.orderBy("n_chars")).collect()))
    test_of_rows_with_one_id_and_text_the_same_stays.seen = getattr(test_of_rows_with_one_id_and_text_the_same_stays, "seen", got)
    assert got == test_of_rows_with_one_id_and_text_the_same_stays.seen
