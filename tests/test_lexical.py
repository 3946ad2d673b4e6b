"""The text index against scoring everything, and what early termination leaves unscored."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelpgraph.operators import lexical


def parts(text):
    text = re.sub(r"([a-zé0-9])([A-ZÉ])", r"\1 \2", text or "")
    text = re.sub(r"([A-ZÉ])([A-ZÉ][a-zé])", r"\1 \2", text)
    return [x.lower() for x in re.findall(r"[^\W\d_]+|\d+", text)]


def brute(rows, asked, k, groups=None):
    tf = {i: Counter(parts(t)) for i, t in rows}
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((len(rows) - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    out = []
    for q, text, *of in asked:
        score = {i: round(sum(idf[t] * c[t] / (c[t] + 1.2) for t in set(parts(text)) if t in c), 6) for i, c in tf.items() if set(parts(text)) & set(c) and (groups is None or (i, of[0]) in groups)}
        out += [(q, i, s, r + 1) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


def test_terms(spark):
    said = ["getUserByID", "HTTPServer2x", "order_item-id", "éÉcole", "", None, "a.b(C)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(lexical.terms(F.col("t"))).collect()]
    assert got == [["get", "user", "by", "id"], ["http", "server", "2", "x"], ["order", "item", "id"], ["é", "école"], [], [], ["a", "b", "c"]]
    assert got == [parts(t) for t in said]


@pytest.mark.parametrize("seed", [1, 2])
def test_answers_and_candidates(spark, seed):
    """A word that is everywhere, words of falling frequency, ties, repeats, questions of common words only or of unknown ones."""
    g = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    pick = lambda n: " ".join(words[min(299, int(g.expovariate(1 / 40)))] for _ in range(n))
    rows = [(i, f"the {pick(g.randint(0, 12))} the") for i in range(600)] + [(700 + i, "the same text twice") for i in range(5)] + [(900, None), (901, "")]
    asked = [(i, f"where is the {pick(3)}?", "a" if i % 2 else "b") for i in range(40)] + [(90, "the", "a"), (91, "unknown words here", "b"), (92, None, "a"), (93, "same same TWICE", "b")]
    index = lexical.TextIndex(spark.createDataFrame(rows, "id long, text string"))
    questions = spark.createDataFrame(asked, "query_id long, text string, group string")
    answers, scored = index.explain(questions, 10)
    want = brute(rows, asked, 10)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in answers.collect()) == want
    counted = {r.query_id: r.candidates for r in scored.collect()}
    assert sum(counted.get(i, 0) for i in range(40)) < 0.7 * 40 * 605  # every document shares "the" with every question
    groups = [(i, "a" if i % 3 else "b") for i, _ in rows] + [(5, "b"), (5, "a"), (5, "a")]
    got = index.search(questions, 4, spark.createDataFrame(groups, "id long, group string"))
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == brute(rows, asked, 4, set(groups))


def test_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a b")], "id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert lexical.TextIndex(rows.limit(0)).search(asked, 3).count() == 0
    assert lexical.TextIndex(rows).search(asked.limit(0), 3).count() == 0


def test_many_cells(spark, monkeypatch):
    """Postings and questions over several cells: no row a candidate is written, and the answers stay."""
    monkeypatch.setattr(lexical, "CELL_POSTINGS", 300)
    monkeypatch.setattr(lexical, "CELL_TERMS", 40)
    g = random.Random(4)
    rows = [(f"ä{i}" if i % 9 == 0 else f"k{i}", "the " + " ".join(f"w{chr(97 + min(25, int(g.expovariate(1 / 6))))}" for _ in range(g.randint(1, 9)))) for i in range(400)]
    rows += [(f"same{i}", "the twin text") for i in range(40)]
    asked = [(i, f"the wa w{chr(97 + i % 26)}{' twin' if i % 3 == 0 else ''}") for i in range(50)]
    saved = []
    real = lexical.save
    monkeypatch.setattr(lexical, "save", lambda df, name: saved.append(real(df, name)) or saved[-1])
    got = lexical.TextIndex(spark.createDataFrame(rows, "id string, text string")).search(spark.createDataFrame(asked, "query_id long, text string"), 6)
    assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got.collect()) == brute(rows, asked, 6)
    postings = sum(len(set(parts(t))) for _, t in rows)
    assert max(df.count() for df in saved) <= max(postings, 50 * 6 * 10)
