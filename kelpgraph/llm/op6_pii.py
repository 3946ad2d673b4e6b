"""Operator 6: personal data by candidate generation and gradient-boosted trees.

High-recall generators propose spans of four kinds that may overlap. The base
patterns' valid matches are always personal data. All other proposals (base
matches that fail their test, and matches of the wider patterns) are scored by
boosted trees on features of the span's format and of its context; a threshold
per kind, calibrated on labelled proposals the trees didn't see, decides.

The trees are fitted on base matches (valid or not) and on near misses of the same
kinds, at most ``FIT_ROWS`` of each, the least by a content hash; near misses are
looked for in about ``NEAR_DOCS`` documents. Valid base
matches, and ``SEEDS`` made-up ones a kind, are rewritten in the wider formats in
their own contexts (personal data), spoiled (not personal data), and put behind
words that say what else they are, such as an order's or a part's number (not
personal data, whatever the format). What comes from one match is either learned
from or calibrated on. Digits aren't counted by any feature: the label is no
restatement of one, and only the context tells a number of an order from a card's.

DataFrame functions and Spark ML only.
"""

from __future__ import annotations

import json
import random
import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 20_000
#: Documents in which near misses are looked for, about: those of the least hashes.
NEAR_DOCS = 20_000
SEEDS = 90
PRECISION = 0.99
AROUND = 24

#: The base patterns of the contract, made linear: possessive where nothing can be
#: given back, and started only where a leftmost match can start.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider proposals: written-out or spaced addresses, other groupings, no plus sign.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?(?:@|[(\[{] ?(?:at|AT) ?[)\]}]) ?| AT )[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]) ?| DOT )[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}::(?:[0-9A-Fa-f]{1,4}:){1,5}[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"
    r"|(?<![0-9.])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:(?: ?[./_] ?[0-9]{4}){3}|[./_][0-9]{6}[./_][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+(])(?<![0-9+][().\x20-])0[1-9][0-9]{0,3}(?:[ ./-][0-9]{2,4}){2,4}(?![0-9])",
}
#: What looks like a kind and isn't of it: no top-level domain, versions and times, too few digits.
NEAR = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?@ ?[A-Za-z0-9-]{1,63}+(?! ?[.(\[])",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,4}(?:\.[0-9]{1,4}){1,2}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])",
    "card": r"(?<![0-9])(?<![0-9][./_\x20-])[0-9]{4}(?:[./_\x20-]?[0-9]{4}){1,2}(?![./_\x20-]?[0-9])",
    "phone": r"(?<![0-9+(])(?<![0-9+][().\x20-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?![0-9]|[ .-][0-9])",
}
#: What a text must hold before the pattern is tried at all.
NEED = {"email": r"@|[(\[{] ?(?:at|AT) ?[)\]}]| AT ", "ip": r"[0-9] ?[.:\[(]|[0-9A-Fa-f]:[0-9A-Fa-f:]", "card": r"[0-9][^A-Za-z]{0,3}[0-9]", "phone": r"[0-9]"}
CUES = {"email": r"mail|contact|write", "ip": r"\bip\b|host|addr|server", "card": r"card|visa|credit|pay", "phone": r"tel|phone|call|fax|mobil"}

#: Words that say a number or name behind them is something else.
DECOYS = ("order", "invoice", "item", "sku", "isbn", "serial", "version", "build", "ticket", "batch", "model", "part", "commande", "factura", "pedido", "rechnung", "bestellung", "artikel")

_SPAN = "array<struct<start:int,end:int,hit:string>>"
#: Elements of one block of a running sum or maximum over an array.
_BLOCK = 256


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often the lambda refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, hit) of every match in order, in code points, end exclusive.

    The text between the matches and the matches themselves alternate, so running
    sums of both lengths are the offsets. Sums run inside blocks of 256 matches
    and over the blocks, so that very many matches stay cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(found):
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("hit")))
        total = lambda b: F.aggregate(b, F.lit(0), lambda x, s: x + s["g"] + s["m"])
        offsets = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda x, b: F.concat(x, F.array(F.element_at(x, -1) + total(b))))

        def inside(block, offset):
            start = F.struct(offset.alias("at"), F.array().cast(_SPAN).alias("out"))
            span = lambda x, s: F.struct((x["at"] + s["g"]).alias("start"), (x["at"] + s["g"] + s["m"]).alias("end"), s["hit"].alias("hit"))
            grow = lambda x, s: F.struct((x["at"] + s["g"] + s["m"]).alias("at"), F.concat(x["out"], F.array(span(x, s))).alias("out"))
            return F.aggregate(block, start, grow, lambda x: x["out"])

        return once(steps, lambda s: once(_blocks(s), lambda bs: F.flatten(F.zip_with(bs, F.slice(offsets(bs), F.lit(1), F.size(bs)), inside))))

    return once(found, lambda f: F.when(F.size(f) > 0, located(f)).otherwise(F.array().cast(_SPAN)))


def greatest_before(values: Column) -> Column:
    """For each of the numbers the greatest before it, 0 at the first; blockwise, as above."""
    carried = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda x, b: F.array_append(x, F.greatest(F.element_at(x, -1), F.array_max(b))))

    def inside(block, carry):
        start = F.struct(carry.alias("top"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, start, lambda x, v: F.struct(F.greatest(x["top"], v).alias("top"), F.array_append(x["out"], x["top"]).alias("out")), lambda x: x["out"])

    return once(_blocks(values), lambda bs: F.flatten(F.zip_with(bs, F.slice(carried(bs), F.lit(1), F.size(bs)), inside)))


def cutter(text: Column):
    """(wide, cut): four bytes a character, and a function that cuts characters [a, b) of them at a cost of b - a."""
    return F.encode(text, "UTF-32"), lambda wide, a, b: F.decode(F.substring(wide, 4 * a + 1, 4 * (b - a)), "UTF-32")


def proposals(text: Column, kind: str, pattern: str) -> Column:
    """Array of (start, end, hit) for one pattern; empty unless the text holds what the pattern needs."""
    return F.when(text.rlike(NEED[kind]), spans(text, pattern)).otherwise(F.array().cast(_SPAN))


def valid(kind: str, hit: Column) -> Column:
    """The contract's test of a base match."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == "card":
        n = F.length(digits)
        digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = lambda i: F.when(i % 2 == 1, digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)).otherwise(digit(i))
        luhn = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), doubled), F.lit(0), lambda x, y: x + y)
        return (n >= 13) & (n <= 19) & (luhn % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with one column of base matches (start, end, hit) a kind, valid or not: __email, __ip, __card, __phone."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({f"__{kind}": proposals(text, kind, BASE[kind]) for kind in KINDS})


def _passes(kind: Column, hit: Column) -> Column:
    """What a kind asks of a span in any format: a card's check digit, parts of a dotted address up to 255."""
    dotted = F.regexp_replace(hit, r" ?[\[(](?:\.|dot)[\])] ?", ".")
    return F.when(kind == "card", valid("card", hit)).when((kind == "ip") & dotted.contains("."), valid("ip", dotted)).otherwise(True)


FEATURES = ("passes", "colons", "marks", "written", "sentence", "domain", "kind", "length", "n_letters", "n_dots", "n_spaces", "n_dashes", "plus", "parens", "groups", "before_word", "after_word", "cue", "decoy", "digits_around", "distinct")


def featured(candidates: DataFrame) -> DataFrame:
    """Format and context features of candidates (kind, hit, before, after)."""
    hit, count = F.col("hit"), lambda p: F.regexp_count("hit", F.lit(p)).cast("double")
    cue = F.coalesce(*(F.when(F.col("kind") == k, F.lower("before").rlike(CUES[k])) for k in KINDS), F.lit(False))
    kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(i))) for i, k in enumerate(KINDS)), F.lit(0.0))
    made = dict(zip(FEATURES, (
        _passes(F.col("kind"), hit).cast("double"), count(":"), count("[/_]"), count(r"[(\[]"), hit.rlike(r"\. ?[A-Z]|\. ").cast("double"), hit.rlike(r"[A-Za-z0-9-](?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| DOT )[A-Za-z]{2,24}$").cast("double"),
        kind, F.length("hit").cast("double"), count("[A-Za-z]"), count(r"\."), count(" "), count("-"),
        hit.contains("+").cast("double"), hit.contains("(").cast("double"), count("[0-9]+"),
        F.col("before").rlike(r"[\p{L}\p{N}]$").cast("double"), F.col("after").rlike(r"^[\p{L}\p{N}]").cast("double"), cue.cast("double"),
        F.lower("before").rlike(rf"(?:{'|'.join(DECOYS)})\P{{L}}{{0,8}}(?:n[o°º]\.?|nr\.?|number)?\P{{L}}{{0,4}}$").cast("double"),
        F.length(F.regexp_replace(F.concat("before", "after"), "[^0-9]", "")).cast("double"),
        F.size(F.array_distinct(F.split("hit", ""))).cast("double"),
    ), strict=True))
    return VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features").transform(candidates.withColumns({f"f_{c}": v for c, v in made.items()}))


def _candidates(docs: DataFrame) -> DataFrame:
    """Every proposal and near miss as a row (doc_id, dk, kind, by, ok, start, end, hit, before, after); by: base, wide or near, the pattern it is of."""
    text = F.col("text")
    keyed = with_base(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("dk"), F.coalesce("text", F.lit("")).alias("text")).where(text.rlike(r"[0-9@\[({]| AT ")))
    wide, cut = cutter(text)

    def tag(wide, size, kind, by):
        context = lambda s: (cut(wide, F.greatest(s["start"] - AROUND, F.lit(0)), s["start"]).alias("before"), cut(wide, s["end"], F.least(s["end"] + AROUND, size)).alias("after"))
        ok = lambda s: valid(kind, s["hit"]) if by == "base" else F.lit(False)
        return lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(by).alias("by"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), ok(s).alias("ok"), *context(s))

    share = min(1.0, NEAR_DOCS / max(1, docs.count()))
    sampled = F.pmod(F.xxhash64("dk"), F.lit(1 << 20)) < int(share * (1 << 20))
    near = [(F.when(sampled, proposals(text, k, NEAR[k])).otherwise(F.array().cast(_SPAN)), k, "near") for k in KINDS]
    sources = [(F.col(f"__{k}"), k, "base") for k in KINDS] + [(proposals(text, k, WIDE[k]), k, "wide") for k in KINDS] + near
    listed = keyed.select("doc_id", "dk", "text", F.array(*(F.struct(a.alias("a")) for a, _, _ in sources)).alias("all")).where(F.exists("all", lambda x: F.size(x["a"]) > 0))
    every = once(wide, lambda w: once(F.length(text), lambda n: F.concat(*(F.transform(F.col("all")[i]["a"], tag(w, n, k, by)) for i, (_, k, by) in enumerate(sources)))))
    return listed.select("doc_id", "dk", F.explode(every).alias("c")).select("doc_id", "dk", "c.*")


def _seeds(spark: SparkSession) -> DataFrame:
    """Made-up valid base matches of every kind (kind, hit, before, after)."""
    rng = random.Random(6)
    pick = lambda letters, least, most: "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))
    rows = []
    for i in range(SEEDS):
        body = pick("0123456789", 15, 15)
        check = next(c for c in "0123456789" if sum(sum(divmod(2 * int(x), 10)) if j % 2 else int(x) for j, x in enumerate(reversed(body + c))) % 10 == 0)
        made = {
            "email": f"{pick(string.ascii_lowercase, 2, 8)}{rng.choice(['', '.', '_'])}{pick(string.ascii_lowercase + string.digits, 1, 6)}@{pick(string.ascii_lowercase, 3, 10)}{rng.choice(['', '.' + pick(string.ascii_lowercase, 2, 7)])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'info'])}",
            "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            "card": body + check,
            "phone": f"+{rng.randint(1, 99)} {pick('23456789', 1, 1)}{pick('0123456789', 2, 2)} {pick('0123456789', 3, 3)}-{pick('0123456789', 4, 4)}",
        }
        cue = {"email": "mail", "ip": "server", "card": "card", "phone": "call"}
        rows += [{"kind": k, "hit": h, "before": f"{pick(string.ascii_lowercase, 2, 9)} {cue[k] if i % 3 == 0 else pick(string.ascii_lowercase, 2, 9)}{rng.choice([' ', ': '])}", "after": f"{rng.choice([' ', '. ', ', '])}{pick(string.ascii_lowercase, 2, 9)}"} for k, h in made.items()]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:string,hit:string,before:string,after:string>>")))


def _rewritten(kind: Column, hit: Column) -> Column:
    """Array of (hit, label, decoy): a valid base match in wider formats (1), spoiled ones (0), and its formats as something else's number (0); without null ones."""
    which = lambda *forms: F.element_at(F.array(*forms), (F.pmod(F.xxhash64(hit, F.lit("form")), F.lit(len(forms))) + 1).cast("int"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    user, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    first = F.substring_index(host, ".", 1)
    hexes = F.md5(hit)
    colons = F.regexp_replace(hexes, "(.{4})(?=.)", "$1:")
    grouped = lambda d: which(*(F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{x}") for x in "./_"))
    wrong = F.concat(F.substring(digits, 1, 15), ((F.substring(digits, 16, 1).cast("int") + 1 + F.pmod(F.xxhash64(hit), F.lit(9))) % 10).cast("int").cast("string"))
    last = F.when(F.length(digits) >= 10, F.substring(digits, -10, 10))
    split = lambda a, b, c: F.regexp_replace(last, "^(...)(...)(....)$", f"{a}$1{b}$2{c}$3")
    defanged = which(*(F.regexp_replace(hit, r"\.", x) for x in ("[.]", " (dot) ", "(.)")))
    short = which(*(F.regexp_replace(colons, f"^((?:[^:]+:){{{a}}})(?:[^:]+:){{{b}}}", "$1:") for a, b in ((2, 3), (1, 4), (2, 4), (3, 2), (2, 5))))
    nine = F.when(F.length(digits) >= 9, F.substring(digits, -9, 9))
    inland = which(*(F.regexp_replace(nine, "^(.)(..)(..)(..)(..)$", f"0$1{x}$2{x}$3{x}$4{x}$5") for x in " .-"), *(F.regexp_replace(nine, "^(..)(...)(....)$", f"0$1{x}$2 $3") for x in " /-"))
    sep = which(*map(F.lit, "./-"))
    date = F.concat(F.lit("0"), (F.pmod(F.xxhash64(hit), F.lit(9)) + 1).cast("string"), sep, F.lit("1"), F.pmod(F.xxhash64(hit, F.lit(1)), F.lit(3)).cast("string"), sep, F.lit("20"), F.substring(digits, 1, 2))
    good = {
        "email": [which(F.concat(user, F.lit(" (at) "), F.regexp_replace(host, r"\.", " (dot) ")), F.concat(user, F.lit(" @ "), host), F.concat(user, F.lit("[at]"), F.regexp_replace(host, r"\.", "[dot]")), F.concat(user, F.lit(" (at) "), host), F.concat(user, F.lit(" AT "), F.regexp_replace(host, r"\.", " DOT ")))],
        "ip": [which(colons, F.regexp_replace(colons, "(?<=:)0+(?=[0-9a-f])", ""), F.upper(colons)), short, defanged],
        "card": [F.when(F.length(digits) == 16, grouped(digits))],
        "phone": [which(split("(", ") ", "-"), split("", "-", "-"), split("", ".", "."), split("", " ", " "), split("00" + "1 ", " ", " ")), inland],
    }
    bad = {
        "email": [which(F.concat(user, F.lit("@"), first), F.concat(user, F.lit(" @ "), first), F.concat(user, F.lit(" (at) "), first)), F.concat(user, F.lit(" @ "), first, F.lit(". "), which(F.initcap(first), first)), F.concat(user, F.lit(" @ "), F.length(host).cast("string"), F.lit(".50"))],
        "ip": [which(F.substring_index(hit, ".", 3), F.substring_index(hit, ".", 2), F.substring(colons, 1, 14), F.regexp_replace(F.substring(digits, 1, 6), "(..)(?=.)", "$1:")), which(F.concat((F.pmod(F.xxhash64(hit), F.lit(700)) + 256).cast("string"), F.regexp_replace(which(hit, defanged), "^[0-9]+", "")), F.regexp_replace(F.substring(F.translate(hexes, "abcdef", "012345"), 1, 16), "(..)(?=.)", "$1:"))],
        "card": [F.when(F.length(digits) == 16, which(grouped(wrong), wrong)), grouped(F.substring(digits, 1, 12))],
        "phone": [which(F.regexp_replace(F.substring(digits, -7, 7), "^(...)", "$1-"), F.regexp_replace(F.substring(digits, -7, 7), "^(...)", "$1 ")), which(F.regexp_replace(F.substring(digits, -4, 4), "^(..)", "$1-"), F.regexp_replace(F.substring(digits, -8, 8), "^(....)(..)", "$1-$2-")), date],
    }
    label = lambda x, y, d: F.struct(x.alias("hit"), F.lit(y).alias("label"), F.lit(d).alias("decoy"))
    forms = lambda k: F.array(*(label(x, 1.0, False) for x in good[k]), *(label(x, 0.0, False) for x in bad[k]), *(label(x, 0.0, True) for x in good[k]))
    return F.filter(F.coalesce(*(F.when(kind == k, forms(k)) for k in KINDS)), lambda x: x["hit"].isNotNull())


def _decoyed(before: Column, hit: Column) -> Column:
    """``before`` with a decoy's word and what may follow it at its end."""
    pick = lambda salt, forms: F.element_at(F.array(*map(F.lit, forms)), (F.pmod(F.xxhash64(hit, before, F.lit(salt)), F.lit(len(forms))) + 1).cast("int"))
    said = F.concat(pick("word", DECOYS), pick("then", (" ", ": ", " no. ", " #", " number ")))
    return F.substring(F.concat(before, F.lit(" "), said), -AROUND, AROUND)


def fit(candidates: DataFrame, rows: int = FIT_ROWS) -> tuple[GBTClassificationModel, dict[str, float]]:
    """Trees and the score threshold of each kind."""
    order = F.xxhash64("dk", "kind", "start")
    least = lambda by: candidates.where(F.col("by") == by).orderBy(order, "dk", "kind", "start").limit(rows).select("kind", "hit", "before", "after", F.col("ok").cast("double").alias("label"))
    real = save(least("base").unionByName(least("near")), "op6-real")
    model_of = real.where("label = 1").drop("label").unionByName(_seeds(candidates.sparkSession))
    made = model_of.select("kind", F.col("hit").alias("of"), "before", "after", F.explode(_rewritten(F.col("kind"), F.col("hit"))).alias("m"))
    context = F.when(F.col("m.decoy"), _decoyed(F.col("before"), F.col("m.hit"))).otherwise(F.col("before"))
    made = made.select("kind", "of", context.alias("before"), "after", "m.hit", "m.label", F.lit(True).alias("made"))
    both = real.select("kind", F.col("hit").alias("of"), "before", "after", "hit", "label", F.lit(False).alias("made")).unionByName(made)
    known = save(featured(both).select("kind", "features", "label", "made", (F.pmod(F.xxhash64("of"), F.lit(3)) == 0).alias("later")), "op6-labelled")
    model = GBTClassifier(maxIter=16, maxDepth=5, stepSize=0.3, seed=7, maxBins=32).fit(known.where("not later"))
    # Calibrated on what is scored later on: all but valid base matches.
    scored = model.transform(known.where("later and (made or label = 0)")).select("kind", "label", (F.floor(vector_to_array("probability")[1] * 100) / 100).alias("p"))
    # At most 101 score steps a kind reach the driver.
    steps = sorted(((r["kind"], r["p"], r["good"], r["n"]) for r in scored.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()), reverse=True)
    cut: dict[str, float] = {}
    for kind in KINDS:
        good = n = 0
        mine = [x[1:] for x in steps if x[0] == kind]
        for (p, g, m), below in zip(mine, [x[0] for x in mine[1:]] + [0.0], strict=True):
            good, n = good + g, n + m
            if good >= PRECISION * n:
                # Halfway to the next step below, since scores between the two weren't seen.
                cut[kind] = max(0.5, (p + below) / 2)
    return model, cut


def _decided(found: DataFrame, rows: int) -> DataFrame:
    """``accepted`` of the proposals that reach their kind's threshold, beside the base spans."""
    model, cut = fit(found, rows)
    # A kind without a threshold is one whose labels reach the wanted precision at no score.
    bar = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in cut.items()), F.lit(2.0))
    scored = model.transform(featured(found.where("by = 'wide' or (by = 'base' and not ok)"))).withColumn("p", vector_to_array("probability")[1])
    kept = scored.where(F.col("p") >= bar).select("doc_id", "dk", "kind", "start", "end", "p", F.lit(False).alias("base"))
    own = found.where("by = 'base' and ok").select("doc_id", "dk", "kind", "start", "end", F.lit(1.0).alias("p"), F.lit(True).alias("base"))
    return accepted(kept.unionByName(own))


def added_spans(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Rows (doc_id, dk, extra): the spans (kind, start, end) that the trees add to a document's base ones."""
    return _decided(save(_candidates(docs), "op6-candidates"), rows)


def span_table(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Rows (doc_id, dk, base, extra) of the documents with a span: base and added ones as (rank, start, end, kind), by kind, then start.

    The patterns run over each text once; all that follows works on what they found.
    """
    found = save(_candidates(docs), "op6-candidates")
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)), F.lit(len(KINDS)))
    own = found.where("by = 'base' and ok").select("doc_id", "dk", "kind", "start", "end", F.lit(True).alias("own"))
    more = _decided(found, rows).select("doc_id", "dk", F.explode("extra").alias("e")).select("doc_id", "dk", "e.kind", "e.start", "e.end", F.lit(False).alias("own"))
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    both = own.unionByName(more).groupBy("doc_id", "dk")
    listed = lambda which: F.sort_array(F.collect_set(F.when(which, span)))
    return save(both.agg(listed(F.col("own")).alias("base"), listed(~F.col("own")).alias("extra")), "op6-spans")


def accepted(found: DataFrame) -> DataFrame:
    """Rows (doc_id, dk, extra): of the spans (doc_id, dk, kind, start, end, p, base) the added ones that cross no base span and, the best first, none accepted so far.

    Spans are swept in order of their starts, once from either side; only those that
    chain together by overlaps are compared with one another.
    """
    text = Window.partitionBy("doc_id", "dk")
    upto = Window.unboundedPreceding, Window.currentRow
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(text.orderBy("start").rangeBetween(*upto))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(text.orderBy(F.desc("start")).rangeBetween(*upto))
    swept = found.distinct().withColumn("ended", ended).withColumn("begins", begins)
    free = swept.where(~F.col("base") & (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("begins", F.col("end")) >= F.col("end")))
    order = text.orderBy("start", "end", "kind")
    apart = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")
    chained = free.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum("apart").over(order.rowsBetween(*upto)))
    ranked = chained.groupBy("doc_id", "dk", "chain").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("worse"), "start", "end", "kind"))).alias("s"))
    cross = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    best = F.aggregate("s", F.array().cast("array<struct<worse:double,start:int,end:int,kind:string>>"), lambda kept, s: F.when(F.exists(kept, lambda b: cross(s, b)), kept).otherwise(F.array_append(kept, s)))
    single = ranked.select("doc_id", "dk", F.explode(F.when(F.size("s") > 1, best).otherwise(F.col("s"))).alias("s"))
    return single.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("s.kind", "s.start", "s.end")).alias("extra"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _with_spans(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """``keyed`` (doc_id, __dk) with __base and __extra, empty where a document has none."""
    none = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    mine = table.select(F.col("doc_id").alias("__id"), F.col("dk").alias("__key"), F.col("base").alias("__b"), F.col("extra").alias("__e"))
    both = keyed.join(mine, (F.col("__dk") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return both.withColumns({"__base": F.coalesce("__b", none), "__extra": F.coalesce("__e", none)})


def find_pii(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans; spans lists these and the added
    ones as kind:start:end. Null text counts as empty; other columns are ignored;
    equal rows get equal results.
    """
    out = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("__dk")), span_table(docs, rows))
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("__base", "__extra"))).alias("spans"))


def redact(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with every span in text replaced by its kind in square brackets; n_chars, if there, follows.

    Where spans overlap, the one that starts first (then the longer) names the
    replacement of their union. Null texts stay null; other columns, of whatever
    name, stay as they are.
    """
    out = _with_spans(docs.withColumn("__dk", F.xxhash64("doc_id", "text")), span_table(docs.select("doc_id", "text"), rows))
    found = F.concat("__base", "__extra")
    byplace = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    wide, cut = cutter(F.col("text"))

    def piece(wide, s, top):
        gap = F.when(s["start"] > top, cut(wide, top, s["start"])).otherwise("")
        name = F.when(s["start"] >= top, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.when(-s["back"] <= top, "").otherwise(F.concat(gap, name))

    def rewritten(wide, spans):
        ends = F.transform(spans, lambda s: -s["back"])
        pieces = F.array_join(F.zip_with(spans, greatest_before(ends), lambda s, top: piece(wide, s, top)), "")
        return F.concat(pieces, cut(wide, F.array_max(ends), F.length("text")))

    clean = once(wide, lambda w: once(byplace, lambda spans: rewritten(w, spans)))
    none = F.size("__base") + F.size("__extra")
    out = out.withColumn("__clean", F.when(F.col("text").isNull() | (none == 0), F.col("text")).otherwise(clean))
    columns = [F.col("__clean").alias("text") if c == "text" else F.length("__clean").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)
