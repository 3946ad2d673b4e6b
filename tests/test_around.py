"""What lies around a hit: the first lines are those of both whole traversals, and no level keeps more of an origin than they need."""

import random

import pytest

from kelpgraph.operators import rag, traverse, vectors
from kelpgraph.plans.codegraph import CodeGraph


@pytest.mark.parametrize("share", [0.01, 0.05, 0.5])
@pytest.mark.parametrize("lines", [1, 7, 30])
def test_first_lines_of_both_ways(spark, monkeypatch, share, lines):
    g = random.Random(3)
    names = [f"C{g.choice('äbZ')}.m{i}" for i in range(80)]
    edges = [(a, b, t) for a in names for b in names if g.random() < share for t in g.sample(("internal", "external"), g.choice((1, 2)))]
    df = spark.createDataFrame(edges, "s string, d string, type string")
    sources = spark.createDataFrame([(n, n) for n in names[::3]] + [("two", names[1]), ("two", names[2]), ("none", "nowhere")], "origin string, node string")
    whole = traverse.reach(df, sources, 3).unionByName(traverse.reach(df, sources, 3, up=True))
    want = {}
    for r in {(r.origin, r.depth, r.node) for r in whole.collect()}:
        want.setdefault(r[0], []).append(r[1:])
    levels = []
    real = traverse.save
    monkeypatch.setattr(traverse, "save", lambda t, name: levels.append((name, real(t, name))) or levels[-1][1])
    got = {}
    for r in traverse.around(df, sources, 3, lines).collect():
        got.setdefault(r.origin, []).append((r.depth, r.node))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:lines] for k, v in want.items()}
    origins = sources.select("origin").distinct().count()
    assert all(t.count() <= 2 * lines * origins for name, t in levels if name.startswith("around"))


def test_answers_walk_no_dense_level(spark, monkeypatch):
    """Hits in a dense graph have their lines after one call; the second level isn't walked."""
    names = [f"m{i:02}" for i in range(40)]
    methods = spark.createDataFrame([(n, "C", 0) for n in names], "name string, class_name string, param_count int")
    classes = spark.createDataFrame([("C", "/service/C.java", "service", False)], "name string, file_path string, layer string, is_mapper boolean")
    raw = spark.createDataFrame([(a, "C", b, "C", 0, "internal") for a in names for b in names], "caller string, caller_class string, callee string, callee_class string, arg_count int, type string")
    saved = []
    real = traverse.save
    monkeypatch.setattr(traverse, "save", lambda t, name: saved.append(name) or real(t, name))
    hits = spark.createDataFrame([(1, 1, "C.m03"), (1, 2, "C.m05")], "query_id int, rank int, node string")
    (row,) = rag.around_hits(CodeGraph(classes, methods, raw), hits).collect()
    body = "\n".join(f"  1 C.{n}" for n in names[: vectors.LINES])
    assert (row.context, row.refs) == (f"# C.m03\n{body}\n# C.m05\n{body}", "C.m03,C.m05")
    assert saved == ["steps", "around1"]
