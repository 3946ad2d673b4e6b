"""The methods that are read back come with their whole code."""

from kelpgraph import queries
from tests.oracle import rows_of, twin

PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"


def test_methods_with_their_code(spark, tmp_path):
    parts = [(1, "red small", "Brand#11", "t", 1, 1.0), (2, "red small", "Brand#11", "t", 2, 1.0), (3, "blue", "Brand#12", "t", 0, 1.0), (4, "never called", "Brand#12", "t", 3, 1.0)]
    named = [(1, 1, 1, 2.0), (3, 1, 2, 3.0), (2, 1, 3, 1.0), (1, 1, 4, 4.0), (3, 1, 5, 0.0)]  # one order: blue, red_small, itself, Unknown
    lines = [(order, part, supplier, n, quantity, 1.0) for order in (1, 11) for part, supplier, n, quantity in named]
    folder = str(tmp_path)
    for name, rows, schema in (("part", parts, PARTS), ("lineitem", lines, LINES)):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    for name in ("region", "nation", "customer", "supplier", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.range(1).write.parquet(f"{folder}/{name}.parquet")
    found = queries.Q["extract_methods"](spark, folder)
    note = "; // a call(1, 2)\n"
    assert sorted((r["name"], r.class_name, r.param_count, r.code) for r in found.collect()) == [
        ("blue", "Brand12", 0, "public void blue() {\n    fBrand11.red_small(1, 2, 3)" + note + "  }"),
        ("never_called", "Brand12", 3, "public void never_called(int a1, int a2, int a3) {\n  }"),
        ("red_small", "Brand11", 1, "public void red_small(int a1) {\n    fBrand12.blue(1, 2)" + note + "    ghost.blue()" + note + "    red_small(1)" + note + "  }"),
        ("red_small", "Brand11", 2, "public void red_small(int a1, int a2) {\n  }"),
    ]
    assert rows_of(found) == twin(folder, queries.SQL["extract_methods"])


def test_no_method_lacks_its_code(spark):
    from kelpgraph.plans.codegraph import from_tables

    sf = "/root/testdata/sf0.001"
    found = queries._parsed(from_tables(spark, sf))["methods"]
    assert found.where("code is null or length(code) <> `end` - start").count() == 0 < found.count()
