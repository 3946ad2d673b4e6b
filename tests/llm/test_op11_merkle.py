"""Operator 11 against a plain Merkle tree over all rows, and partial proofs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import op11_merkle, queries
from tests.oracle import rows_of, twin

SF = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode() if isinstance((parts or ("",))[0], str) else b"".join(parts)).hexdigest()


def field(v):
    b = v if isinstance(v, bytes) or v is None else str(v).encode()
    return b"-" if b is None else f"{len(b)}:".encode() + b


def climb(level):
    """All levels of one tree; the siblings of each node, level by level."""
    paths = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = range(p // 8 * 8, min(p // 8 * 8 + 8, len(level)))
            paths[i].append(([level[q] for q in run if q < p], [level[q] for q in run if q > p]))
            at[i] = p // 8
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return (level or [None])[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text as bytes or None)."""
    trees = {}
    for d, s, l, n, t in rows:
        leaf = h(*map(field, (d, s, l, n, t)))
        tampered = d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 == 0
        changed = h(*map(field, (d, s, l, n, t.lower()))) if tampered else leaf
        trees.setdefault((l is not None, (l or "").encode()), []).append((d is not None, d or 0, leaf, d, changed))
    subs = {}
    for key in sorted(trees):
        trees[key].sort(key=lambda r: r[:3])
        subs[key] = climb([r[2] for r in trees[key]])
    root, upper = climb([subs[k][0] for k in subs])
    out = []
    for key, up in zip(subs, upper):
        for (_, _, leaf, d, changed), path in zip(trees[key], subs[key][1]):
            folded = changed
            for before, behind in path + up:
                folded = h(*before, folded, *behind)
            proof = h(*(x for a, b in path + up for x in a + b))
            out.append((d, leaf, subs[key][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def of(df):
    return [(r[0], r[1], r[2], r[3], None if r[4] is None else bytes(r[4])) for r in df.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("binary")).collect()]


def got(df):
    assert tuple(df.columns)[:7] == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query_is_the_plain_tree(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(queries.op11_merkle(spark, SF)) == brute(of(df))


ODD = [(None, None, None, None, None), (None, "s", None, 3, "Ab"), (7, None, "en", None, "AB"), (7, None, "en", None, "AB"), (7, "s", "en", 1, ""), (2**60 + 1, "ü", "de", -4, "É A"), (12, "s", "en", 2, "x" * 300_000 + "Y"), (3, "s", "", 1, "C")]


@pytest.mark.parametrize("copies", [1, 3, 40])
def test_odd_rows_ties_and_clashing_names(spark, copies):
    """Equal rows, null keys, trees of one leaf, names of the operator's own columns; blocks of 64 leaves."""
    many = ODD + [(100 + i, "hot", "en", i, f"Text {i}") for i in range(copies * 20)]
    df = spark.createDataFrame(many, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.union(df.where("doc_id is null or doc_id = 7")).withColumns({c: F.lit("x") for c in ("leaf", "tree", "pos", "n", "block", "rank", "root")})
    assert got(op11_merkle.prove_all(df, step=2)) == brute(of(df))


def test_texts_that_are_not_utf8_and_empty_tables(spark):
    df = spark.sql("SELECT id AS doc_id, 's' AS source, 'en' AS lang, id AS n_chars, cast(unhex('6142FF63') AS string) AS text FROM range(20)")
    assert got(op11_merkle.prove_all(df)) == brute(of(df))
    assert op11_merkle.prove_all(df.limit(0)).count() == 0
    assert got(op11_merkle.prove_all(df.limit(1))) == brute(of(df.limit(1)))


def test_proofs_of_some_rows_only(spark):
    """The same rows as of all proofs, from the coordinates of the chosen ones."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    some = spark.range(0, 200, 7).withColumnRenamed("id", "doc_id")
    want = [r for r in brute(of(df)) if r[0] % 7 == 0]
    assert got(op11_merkle.prove_all(df, some, step=1)) == want


def test_missing_coordinates_are_the_least_union():
    """A node is asked for if a proof needs it and no chosen leaf is below it; siblings are asked for once."""
    for n, chosen in ((1, [0]), (8, [0, 3]), (70, [0, 1, 9, 69]), (513, [512]), (600, list(range(600)))):
        need, size, level = set(), n, 0
        while size > 1:
            have = {p // 8**level for p in chosen}
            need |= {(level, q) for p in have for q in range(p // 8 * 8, min(p // 8 * 8 + 8, size)) if q not in have}
            size, level = -(-size // 8), level + 1
        found = op11_merkle.missing(chosen, n)
        assert len(found) == len(set(found)) and set(found) == need


def test_twin(spark):
    if "op11_merkle" in queries.oracle_sql():
        assert rows_of(queries.op11_merkle(spark, SF)) == twin(SF, queries.oracle_sql()["op11_merkle"])
