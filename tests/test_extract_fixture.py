"""One-pass extraction: a source with awkward forms, batches smaller than a file, the table function, odd sources."""

import pathlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpgraph.operators import extract, scopes

SOURCE = (pathlib.Path(__file__).parent / "java" / "Shop.java").read_text()


def parsed(spark, sources):
    return extract.parse(spark.createDataFrame(sources, "path string, content string"), with_code=True)


@pytest.fixture(scope="module")
def shop(spark):
    return {k: v.cache() for k, v in parsed(spark, [("Shop.java", SOURCE)]).items()}


def test_classes(shop):
    assert sorted((r.class_name, r.kind) for r in shop["classes"].collect()) == [("Inner", "class"), ("Kind", "enum"), ("Local", "class"), ("Shop", "class")]


def test_methods_and_their_code(shop):
    rows = {(r.class_name, r.name): r for r in shop["methods"].collect()}
    assert {k: (r.param_count, r.return_type) for k, r in rows.items()} == {
        ("Shop", "find"): (2, "List"), ("Shop", "size"): (2, "int"), ("Kind", "rate"): (0, "int"), ("Inner", "run"): (0, "void"), ("Local", "tick"): (0, "void"), ("Shop", "codes"): (0, "array"),
    }
    for r in rows.values():
        assert SOURCE[r.start : r.end] == r.code
    begins = {"find": "@Transactional(rollbackFor", "size": "abstract int size(int[] a, String s);", "rate": "int rate() { return Rates", "tick": "void tick() { clock.now(); }", "codes": "int[] codes() {"}
    for name, text in begins.items():
        (row,) = [r for (c, n), r in rows.items() if n == name]
        assert row.code.startswith(text) and row.code[-1] in "};"
    assert rows["Shop", "find"].code.endswith(".list();\n    }")


def test_calls_and_their_text(shop):
    rows = shop["calls"].collect()
    got = sorted((r.caller_class, r.caller, r.callee_class, r.callee, r.arg_count, r.type, SOURCE[r.start : r.end]) for r in rows)
    assert got == sorted([
        ("Shop", "find", "OrderDao", "load", 3, "external", 'local.load(ids, wanted.get("a,b"), (a, b) -> a.merge(b))'),
        ("Shop", "find", "Map", "get", 1, "external", 'wanted.get("a,b")'),
        ("Shop", "find", "Unknown", "merge", 1, "external", "a.merge(b)"),
        ("Shop", "find", "Auditor", "note", 1, "external", "((Auditor) this.stock).note(1)"),
        ("Shop", "find", "OrderDao", "rows", 1, "external", "dao.rows(ids)"),
        ("Shop", "find", "OrderDao", "list", 0, "external", "dao.rows(ids).list()"),
        ("Kind", "rate", "Rates", "of", 1, "external", "Rates.of(this)"),
        ("Local", "tick", "Clock", "now", 0, "external", "clock.now()"),
        ("Inner", "run", "Local", "tick", 0, "external", "new Local().tick()"),
        ("Inner", "run", "Clock", "wind", 2, "external", "clock.wind(1, 2)"),
        ("Inner", "run", "Clock", "stop", 0, "external", "clock.stop()"),
        ("Shop", "codes", "Shop", "size", 2, "internal", 'size(null, "")'),
        ("Shop", "codes", "String", "length", 0, "external", '"abc".length()'),
    ])


def test_pieces_cover_every_character(spark):
    df = spark.createDataFrame([("a", SOURCE), ("b", "x = 'it''s /* \" // */ \\"), ("c", None), ("d", "")], "path string, content string")
    got = {r.path: r.whole for r in extract.pieces(df).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("whole")).collect()}
    assert got == {"a": SOURCE, "b": "x = 'it''s /* \" // */ \\"}


@pytest.mark.parametrize("size", [1, 7, 100_000])
def test_files_over_many_batches(spark, size):
    """The machine goes on where the batch before ended."""
    tokens = [(p, r.i, r.t) for p in ("A", "B") for r in extract.pieces(spark.createDataFrame([(p, SOURCE)], "path string, content string")).orderBy("i").collect()]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("path", "i", "t"), map(list, zip(*tokens[k : k + size]))))) for k in range(0, len(tokens), size)]
    rows = [r for b in scopes.follow(batches, True) for r in zip(*(c.to_pylist() for c in b.columns))]
    once = scopes.Scopes("A", True)
    for _, _, t in tokens[: len(tokens) // 2]:
        once.feed(t)
    assert [r for r in rows if r[1] == "A"] == list(once.found()) and len(rows) == 2 * len([r for r in rows if r[1] == "A"])


def test_one_exchange(spark):
    plan = extract.pieces(spark.createDataFrame([("a", SOURCE)], "path string, content string")).mapInArrow(lambda b: scopes.follow(b, False), scopes.FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_table_function(spark):
    extract.register(spark)
    sources = spark.createDataFrame([(f"S{i}.java", SOURCE) for i in range(5)], "path string, content string")
    extract.pieces(sources).createOrReplaceTempView("p")
    got = spark.sql("SELECT * FROM java_scopes(TABLE(p) PARTITION BY path ORDER BY i)")
    want = {k: v for k, v in extract.parse(sources, with_code=True).items()}
    assert sorted((r.path, r.name, r.start, r.end, r.code) for r in got.where("kind = 'method'").collect()) == sorted((r.path, r["name"], r.start, r.end, r.code) for r in want["methods"].collect())
    assert got.where("kind = 'call'").count() == want["calls"].count() == 13 * 5


def test_broken_and_empty_sources(spark):
    """What isn't closed, closes nothing; rows come out for what is whole, and nothing fails."""
    odd = [("1", None), ("2", ""), ("3", "}}}) ] class"), ("4", "class A { void m( {"), ("5", "class A { void m() { x.y(1, (2); } void n() { z.w(); } }"), ("6", '"never closed'), ("7", "/* never closed class A { }"), ("8", "class é { void a() { b.c(); } }"), ("9", "class A { void m() { " + "x.y(); " * 50_000 + "} }")]
    out = parsed(spark, odd)
    calls = out["calls"].groupBy("path").count().collect()
    assert {r.path: r["count"] for r in calls}["9"] == 50_000
    assert out["methods"].where("path = '9'").count() == 1 and out["classes"].where("path in ('1', '2', '3', '6')").count() == 0
    bad = spark.sql("SELECT 'x' AS path, cast(concat(cast('class A { void m() { a.b(); } } // ' AS binary), unhex('FF')) AS string) AS content")
    assert extract.parse(bad)["calls"].count() == 1


def test_a_large_file_is_held_in_little_memory():
    """A file of 40 000 calls: its rows come in parts, and a token costs some dozen bytes."""
    import tracemalloc

    import pyarrow as pa

    calls = 40_000
    each = ["    ", "f", ".", "go", "(", "1", ",", " ", "2", ")", ";", "\n"]
    text = ["class", " ", "Big", " ", "{", "void", " ", "run", "(", ")", "{"] + each * calls + ["}", "}"]

    def batches():
        for at in range(0, len(text), 1000):
            part = text[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(["Big.java"] * len(part)), pa.array(range(at, at + len(part)), pa.int32()), pa.array(part)], names=["path", "i", "t"])

    tracemalloc.start()
    rows, parts = 0, 0
    for b in scopes.follow(batches(), True):
        rows, parts = rows + len(b), parts + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == calls + 2 and parts > 5
    assert peak < 60 * len(text)
