"""Where the variants of fingerprints meet: rows sent a fingerprint, blocks, families, slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import op9_simhash as m
from kelpgraph.llm.components import connected_components

from .test_contracts import brute_links


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sent_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("n", [30_000, 240_000])
def test_as_many_rows_a_fingerprint_on_any_table(spark, n):
    """Five blocks are five rows, and at most five more to count their groups, on a table of any size."""
    fps = m.save(spark.range(n).select(F.xxhash64("id").alias("fp")), "test-op9")
    before = sent_rows(spark)
    assert m.save(m.links(fps), "test-op9-links").count() < n // 10
    assert sent_rows(spark) - before <= 11 * n


@pytest.mark.parametrize("group,blocks", [(20_000, None), (400, None), (100, None), (400, 6), (100, 7)])
def test_blocks_and_balls_lose_no_link(spark, monkeypatch, group, blocks):
    """One group, five to seven blocks; chains of near copies, and a family that must be split."""
    g = np.random.default_rng(group)
    family = int(g.integers(0, 1 << 63))
    fps = {int(x) for x in g.integers(0, 1 << 64, 500, np.uint64)} | {0, (1 << 64) - 1, 1 << 63}
    fps |= {family ^ sum(1 << int(b) for b in g.choice(64, int(g.integers(0, 4)), replace=False)) for _ in range(150)}
    for s in list(fps)[:100]:
        for _ in range(4):
            for b in g.choice(64, int(g.integers(1, 7)), replace=False):
                s ^= 1 << int(b)
            fps.add(s)
    fps = sorted(fps)
    monkeypatch.setattr(m, "GROUP", group)
    edges = connected_components(m.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), blocks))
    roots = {r.node: r.root for r in edges.collect()}
    got, want = [roots.get(signed(x), signed(x)) for x in fps], brute_links(fps, list(range(len(fps))))
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("limit", [1, 2000, 1 << 20])
def test_every_pair_of_four_bits_collides(limit):
    """In slices of any size, and with bits that a fingerprint had to flip to come to its group."""
    g = np.random.default_rng(3)
    centre = int(g.integers(0, 1 << 63))
    fps = np.array(sorted({centre ^ sum(1 << int(b) for b in g.choice(np.arange(8, 64), int(g.integers(0, 5)), replace=False)) for _ in range(60)}), np.uint64)
    found = {(min(x), max(x)) for a, b in m._collide(fps, np.full(len(fps), 2, np.int8), np.arange(len(fps)), 255, list(range(8, 64)), limit) for x in zip(a.tolist(), b.tolist())}
    near = {(a, b) for b in range(len(fps)) for a in range(b) if int(fps[a] ^ fps[b]).bit_count() <= 4}
    assert found <= near
    parts = brute_links([int(x) for x in fps], list(range(len(fps))))
    label = m._forest(len(fps), *(np.array(x) for x in zip(*sorted(found))), np.arange(len(fps)))
    assert label.tolist() == parts
    current, left = np.array([0b0111, 0b0100], np.uint64), np.array([0, 2], np.int8)
    assert [list(map(tuple, x)) for x in m._collide(current, left, np.arange(2), 0b0100, [0, 1, 3], limit)] == [[(0,), (1,)]]
