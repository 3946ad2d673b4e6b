"""Exact search over several cells against brute force in DuckDB."""

import random

import duckdb
import pytest

from kelpgraph.operators import vectors

SQL = """SELECT query_id, vec_id, d, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank FROM (
SELECT query_id, vec_id, list_sum(list_transform(range(1, 9), lambda i: (v.embedding[i]::DOUBLE - q.q[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.q[i]::DOUBLE))) AS d FROM v JOIN q ON {on}) QUALIFY rank <= 4"""


def literal(x):
    return "NULL" if x is None else f"[{', '.join('NULL' if y is None else f'{y!r}::FLOAT' for y in x)}]::FLOAT[]"


@pytest.mark.parametrize("same", [None, "label"])
def test_cells_against_sql(spark, monkeypatch, same):
    """Copies that tie, missing coordinates, short and null vectors; more vectors and queries than a cell holds."""
    monkeypatch.setattr(vectors, "CELL_VECTORS", 40)
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 7)
    g = random.Random(3)
    rows = [(i, [float(g.randint(-3, 3)) / 4 for _ in range(8)], g.choice([1, 2, None])) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8, 1) for i in range(60)]
    rows += [(2000, None, 1), (2001, [0.5] * 3, 1), (2002, [None, 0.5] * 4, 2), (2003, [None] * 8, 1)]
    asked = [r for r in rows if r[0] % 20 == 0]
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spark.createDataFrame(asked, "query_id long, q array<float>, label int"), 4, same)
    con = duckdb.connect()
    for name, table, columns in (("v", rows, "vec_id, embedding, label"), ("q", asked, "query_id, q, label")):
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM (VALUES {', '.join(f'({i}::BIGINT, {literal(x)}, {lab if lab is not None else "NULL::INT"})' for i, x, lab in table)}) t({columns})")
    want = con.sql(SQL.format(on="v.label = q.label" if same else "true")).fetchall()
    assert got.columns == ["query_id", "vec_id", "d", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_vectors_or_queries(spark):
    v, q = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>")
    assert vectors.top_k(v.limit(0), q, 3).count() == vectors.top_k(v, q.limit(0), 3).count() == 0
