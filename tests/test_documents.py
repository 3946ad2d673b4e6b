"""Ordered text files and nested documents; answers, traces and descriptions from the command line."""

import json

import pytest
from pyspark.sql import functions as F

from kelpgraph.operators import trees
from kelpgraph.plans import build, codegraph
from kelpgraph.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    return codegraph.from_tables(spark, SF)


def test_part_files_in_order_are_the_document(spark, tmp_path):
    lines = spark.range(0, 5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("at")).select("at", F.concat(F.lit("line "), F.col("at").cast("string")).alias("line"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_ordered(lines, str(tmp_path / "doc"), ["at"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = sorted((tmp_path / "doc").glob("part-*"))
    assert len(parts) > 1 and max(p.stat().st_size for p in parts) < 0.6 * sum(p.stat().st_size for p in parts)
    assert "".join(p.read_text() for p in parts) == "".join(f"line {i}\n" for i in range(5000))
    assert [tuple(r) for r in sinks.read_ordered(spark, str(tmp_path / "doc")).orderBy("n").limit(2).collect()] == [(1, "line 0"), (2, "line 1")]


def test_nested_document_is_the_flat_tree(spark, graph, tmp_path):
    sinks.write_ordered(trees.document_lines(graph.classes, graph.nodes), str(tmp_path / "json"), ["key"])
    found = json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
    flat = {}

    def walk(nodes, path):
        assert [n["name"] for n in nodes] == sorted(n["name"] for n in nodes)
        for n in nodes:
            flat[(*path, n["name"])] = n["kind"]
            walk(n.get("children", []), (*path, n["name"]))

    walk(found, ())
    want = {tuple(r.path.split("/")): r.kind for r in trees.package_tree(graph.classes).collect()}
    assert {k: v for k, v in flat.items() if v != "method"} == want
    home = {r["name"]: tuple(r.p) for r in graph.classes.select("name", trees.package_path(F.col("file_path")).alias("p")).collect()}
    assert {k for k, v in flat.items() if v == "method"} == {(*home[r.class_name], r["name"]) for r in graph.nodes.collect()}


def test_odd_names_and_empty_trees(spark):
    classes = spark.createDataFrame([('Q"uote', '/a/Q"uote.java', "other", False), ("B", "/a/b/c/d/e/f/B.java", "other", False), ("None", "", "other", False)], "name string, file_path string, layer string, is_mapper boolean")
    nodes = spark.createDataFrame([("m\\1", 'Q"uote'), ("z", "B"), ("z", "B")], "name string, class_name string")
    text = lambda c, n: json.loads("".join(r.line for r in trees.document_lines(c, n).orderBy("key").collect()))
    (a,) = text(classes, nodes)
    assert [x["name"] for x in a["children"]] == ['Q"uote', "b"] and a["children"][0]["children"] == [{"name": "m\\1", "kind": "method"}]
    assert text(classes.limit(0), nodes) == []


def test_commands(spark, tmp_path, capsys):
    from kelpgraph.__main__ import main

    (tmp_path / "src/controller").mkdir(parents=True)
    (tmp_path / "src/dao").mkdir()
    (tmp_path / "src/controller/OrderController.java").write_text("class OrderController { @Autowired private OrderDao dao; void createOrder(int a) { dao.saveRow(a); check(); } void check() { } }")
    (tmp_path / "src/dao/OrderDao.java").write_text("class OrderDao { void saveRow(int a) { flush(); } void flush() { } }")
    out = str(tmp_path / "graph")
    build.build(spark, str(tmp_path / "src"), out)
    code = spark.read.parquet(f"{out}/{spark.read.parquet(f'{out}/current').first()[0]}/code")
    assert {r["name"]: r.code for r in code.collect()}["flush"] == "void flush() { }"
    main(["ask", out, "who saves a row?", "--top", "1"])
    assert "OrderDao.saveRow" in capsys.readouterr().out
    main(["ask", out, "order", "--layer", "dao", "--top", "3"])
    said = capsys.readouterr().out
    assert "# OrderDao.flush" in said and "# OrderController.check" not in said
    main(["trace", out, "OrderController.createOrder"])
    said = capsys.readouterr().out
    assert "[1] OrderController.createOrder -> OrderDao.saveRow (external)" in said and "[2] OrderDao.saveRow -> OrderDao.flush (internal)" in said
    main(["describe", out, "dao"])
    assert "dao" in capsys.readouterr().out
    main(["json", out, str(tmp_path / "json")])
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))))
