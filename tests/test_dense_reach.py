"""Traversal of dense graphs: the way by predecessors gives what the join gives, without its rows."""

import random

import pytest

from kelpgraph.operators import traverse


@pytest.mark.parametrize("up", [False, True])
@pytest.mark.parametrize("share", [0.03, 0.5])
def test_both_ways_agree(spark, monkeypatch, up, share):
    g = random.Random(5)
    names = [f"C{g.choice('äbZ')}.m{i}" for i in range(150)]
    edges = [(a, b, t) for a in names for b in names[:140] if g.random() < share for t in g.sample(("internal", "external"), g.choice((1, 1, 2)))]
    df = spark.createDataFrame(edges, "s string, d string, type string")
    sources = spark.createDataFrame([(n, n) for n in names[::4]] + [("two", names[1]), ("two", names[2]), ("none", "nowhere")], "origin string, node string")
    plain = traverse.reach(df, sources, 5, up).collect()
    calls = []
    real = traverse._pulled
    monkeypatch.setattr(traverse, "_pulled", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(traverse, "DENSE", 0)
    assert sorted(traverse.reach(df, sources, 5, up).collect()) == sorted(plain)
    assert calls


def test_numbers_follow_the_order(spark):
    names = [f"n{i * 7919 % 1000}" for i in range(1000)] + ["é", "Z", ""]
    got = {r.node: r.id for r in traverse.numbered(spark.createDataFrame([(n,) for n in names * 2], "node string")).collect()}
    assert got == {n: i for i, n in enumerate(sorted(set(names)))}
