"""Operator 12 against brute force: base rules word by word, the two multinomials and every score."""

import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from kelpgraph.llm import op12_rules, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\W_]+|(?:[^\w\x20\x09-\x0D]|_)+")


def hash_text(s):
    return xxhash.xxh64_intdigest(s.encode(), 42)


def hash_pair(a, b):
    return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))


def buckets(text):
    h = [hash_text(t) for t in TOKEN.findall(text or "")]
    return [x % op12_rules.BUCKETS for x in h + [hash_pair(a, b) for a, b in zip(h, h[1:])]]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def brute(docs, labels):
    good = {d for d, q, t in labels if q == 1 and t != 1 and d is not None and zlib.crc32(str(d).encode()) % 5 != 0}
    raw, target = [0] * op12_rules.BUCKETS, [0] * op12_rules.BUCKETS
    for d, t in docs:
        for b in buckets(t):
            raw[b] += 1
            target[b] += d in good
    share = lambda n, total: math.log((n + 1) / (total + op12_rules.BUCKETS))
    ratio = [share(t, sum(target)) - share(r, sum(raw)) for t, r in zip(target, raw)] if sum(target) else [0] * op12_rules.BUCKETS
    out = []
    for d, t in docs:
        b = buckets(t)
        score = sum(ratio[x] for x in b) / len(b) if b else 0.0
        first = base(t)
        out.append((d, *first, not first[-1] and score >= op12_rules.THRESHOLD, round(score, 9)))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"]
    return sorted(((*r[:8], round(r[8], 9)) for r in df.collect()), key=str)


def test_query_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(queries.op12_rules(spark, SF)) == brute(docs, labels)


RUN = "one two three four five six seven eight"
ODD = [(None, None), (None, "a b"), (7, None), (8, ""), (9, " \n\t "), (9, f"{RUN} {RUN} nine"), (9, f"{RUN} {RUN} nine"), (10, f"{RUN}\n{RUN}\n\r\n{RUN} \n{RUN}\n\n\n"), (11, "a " * 40), (12, "x" * 100_000), (13, "é ü " * 30 + "# $ <|>"), (14, " ".join(f"w{i % 997}" for i in range(30_000))), (15, "A_b c-d " + " ".join(f"u{i}" for i in range(60)) + f" {RUN} x {RUN}")]


@pytest.mark.parametrize("labelled", [[], [(9, 1, 0), (9, 0, 0), (10, 1, 1), (11, 1, None), (13, 0, 0), (None, 1, 0), (15, 1, 0), (14, None, None)]])
def test_odd_rows_labels_and_names(spark, labelled):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("quality", "toxic", "ratio", "buckets", "row", "kept", "__w", "trusted")})
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "kept": F.lit(1)})
    assert got(op12_rules.quality_rules(docs, labels)) == brute(ODD, labelled)
    assert op12_rules.keep_good(docs, labels).columns == docs.columns
    assert op12_rules.quality_rules(docs.limit(0), labels).count() == 0
    bad = spark.sql("SELECT 1L AS doc_id, cast(unhex('6142FF63') AS string) AS text")
    assert got(op12_rules.quality_rules(bad, labels))[0][:3] == (1, 1, 4)


def test_labels_that_were_held_out(spark):
    """On the fifth that the target never holds: good documents stay, documents of junk go."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries.op12_rules(spark, sf).where("not base_failed").join(labels, "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0")
    found = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) == 0 and found[1, True] > 40
    assert found.get((0, False), 0) > 3 * found.get((0, True), 0)
