"""Operator 13 against brute force over all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import op13_spelling, queries

SF = "/root/testdata/sf0.001"
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def counts(docs, least=7, times=2):
    n = Counter()
    for d, t in docs:
        for r in map(lower, RUN.findall(t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= times}


def neighbours(words):
    words, by = set(words), {}
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by.setdefault((i, len(w), w[:i] + w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in by.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def brute(docs):
    n = counts(docs)
    near = neighbours(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


def test_query_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert got(queries.op13_spelling(spark, SF)) == want
    assert sum(r[1] is not None for r in want) > 5 and sum(r[4] for r in want) > 1000


def test_chains_of_forms_odd_rows_and_names(spark):
    """Forms of forms, ties of the largest n, equal letters in a row, words of 3000 letters, capitals that stay."""
    long = "ab" * 1500
    said = [("running", 2000), ("runnning", 150), ("runnnning", 12), ("runnnnning", 1), ("runnnnning", 1), ("gunning", 2000), ("punning", 40), ("ÀÉclair", 30), ("àÉclair", 2), ("aaaaaaa", 3), ("aaaaaaaa", 3), ("aaaaaaaaa", 40), (long, 3), (long[:700] + "x" + long[700:], 50), (long[:-1], 2)]
    rows = [(None, None), (None, "Running running"), (3, ""), (4, " \n "), (5, "short words of few"), (5, "short words of few"), (6, "RUNNING-rUnNiNg"), (6, "RUNNING-rUnNiNg")]
    rows += [(10 + i, " ".join([w] * k)) for i, (w, k) in enumerate(said)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "w", "side", "node", "id", "run", "near")})
    want = brute(rows)
    assert got(op13_spelling.variants(df)) == want
    assert 3000 in {len(w) for w, *_ in want}
    assert op13_spelling.variants(df.limit(0)).count() == 0
    assert op13_spelling.variants(spark.sql("SELECT 1L AS doc_id, cast(unhex('61626364656667FF6162636465666763') AS string) AS text")).count() == 0


@pytest.mark.parametrize("letters, least, size", [("ab", 3, 9), ("abc", 4, 8), ("aé", 7, 11)])
def test_walk_finds_all_neighbours(spark, letters, least, size):
    """Dense tries, where every edit has several alignments."""
    g = random.Random(size)
    words = sorted({"".join(g.choice(letters) for _ in range(g.randint(least, size))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    want = sorted((w, x) for w, near in neighbours(words).items() for x in near)
    assert sorted(map(tuple, op13_spelling.near_pairs(df).collect())) == want


def test_very_long_words(spark):
    a = "xyz" * 60_000
    words = [a, a + "x", a[:50_000] + "u" + a[50_001:], a[:-2]]
    got = sorted((len(w), len(x)) for w, x in op13_spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect())
    assert got == [(180_000, 180_000), (180_000, 180_000), (180_000, 180_001), (180_001, 180_000)]
