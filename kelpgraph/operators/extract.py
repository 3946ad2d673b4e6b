"""Extraction of classes, methods and call sites from Java sources.

Sources are dealt by path, cut into pieces by Spark's regular expressions (comments,
literals, words, white space: every character is in one piece, so that positions
survive) and followed in order by one small machine a file (``scopes``). The only
exchange moves the sources; the widest group is one file.

Read: classes, interfaces, enums and records alike; methods of named classes, with
their code; calls in method bodies, those in lambdas and anonymous classes as calls of
the method around them. Offsets are in code points from 0, the end exclusive: a
method's from its first annotation or modifier to its closing brace or semicolon, a
call's from its receiver to its closing parenthesis. A receiver's type comes from, in
this order: a local variable or parameter, a field of the file, an upper-case first
name (a static call), ``new``, a cast, the type a method of the class returns; a longer
chain a.b().c() counts as a call on a. Otherwise it is ``Unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, naming
from ..sources.tables import save
from . import scopes

_STRING = r'"(?:\\.|[^"\\])*+"|\'(?:\\.|[^\'\\])*+\''
_COMMENT = r"//[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
#: Runs of white space and comments, text blocks, strings and characters, words, numbers, anything else.
PIECE = (
    r'(?:\s++|//[^\n]*+|/\*[\s\S]*?\*/){1,64}+|"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\''
    r"|[A-Za-z_$][A-Za-z0-9_$]*+|[0-9][A-Za-z0-9_.]*+|[\s\S]"
)
_GENERIC = r"<[A-Za-z0-9_.,?&\s\[\]]*>"


def cleaned(content: Column) -> Column:
    """Source text without comments, generics and the insides of literals."""
    text = F.regexp_replace(content, f"({_STRING})|{_COMMENT}", "$1")
    text = F.regexp_replace(text, _STRING, '""')
    for _ in range(3):
        text = F.regexp_replace(text, _GENERIC, " ")
    return text


def imports(files: DataFrame) -> DataFrame:
    """Rows (path, name, simple) of plain imports."""
    found = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"import\s+([\w.]+)\s*;"), F.lit(1))).alias("name"))
    return found.withColumn("simple", F.element_at(F.split("name", r"\."), -1))


def annotated_classes(files: DataFrame, rules: dict | None = None) -> DataFrame:
    """Rows (path, class_name, is_mapper, is_service) of classes with a tracked annotation shortly before them.

    ``rules`` may name other annotations: bean_annotations, mapper_annotations.
    """
    beans, mappers = (tuple((rules or {}).get(k) or v) for k, v in (("bean_annotations", fixed.BEAN_ANNOTATIONS), ("mapper_annotations", fixed.MAPPER_ANNOTATIONS)))
    tracked = "|".join((*beans, *mappers))
    pattern = F.lit(rf"@({tracked})\b(?:\([^)]*\))?[\s\S]{{0,400}}?(?:class|interface)\s+([A-Z]\w*)")
    both = F.arrays_zip(F.regexp_extract_all("content", pattern, F.lit(1)).alias("a"), F.regexp_extract_all("content", pattern, F.lit(2)).alias("c"))
    rows = files.select("path", F.explode(both).alias("x")).groupBy("path", F.col("x.c").alias("class_name")).agg(F.collect_set("x.a").alias("anns"))
    mapper, service = naming.stereotype_flags(F.col("anns"), beans, mappers)
    return rows.select("path", "class_name", mapper.alias("is_mapper"), service.alias("is_service"))


def injected_fields(files: DataFrame, rules: dict | None = None) -> DataFrame:
    """Rows (path, field, type) of fields with an injection annotation (``rules``: injection_annotations), which may stand on lines of its own."""
    pattern = F.lit(rf"@(?:{'|'.join((rules or {}).get('injection_annotations') or fixed.INJECTION_ANNOTATIONS)})\b[^;{{]*?([A-Z]\w*)\s+([a-z_]\w*)\s*[;=]")
    code = files.select("path", cleaned(F.col("content")).alias("code"))
    both = F.arrays_zip(F.regexp_extract_all("code", pattern, F.lit(2)).alias("f"), F.regexp_extract_all("code", pattern, F.lit(1)).alias("t"))
    return code.select("path", F.explode(both).alias("x")).select("path", F.col("x.f").alias("field"), F.col("x.t").alias("type"))


#: Pieces in a row of ``piece_lists``.
LIST = 1024


def _cut(files: DataFrame) -> DataFrame:
    """Rows (path, all): the pieces of every source."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.where("content is not null and content <> ''").select("path", F.make_valid_utf8("content").alias("content")).repartition(parts, "path")
    return dealt.select("path", F.regexp_extract_all("content", F.lit(PIECE), F.lit(0)).alias("all"))


def pieces(files: DataFrame) -> DataFrame:
    """Rows (path, i, t): the pieces of every source, a file's in order and in one partition."""
    return _cut(files).select("path", F.posexplode("all").alias("i", "t"))


def piece_lists(files: DataFrame) -> DataFrame:
    """Rows (path, i, t) for ``java_scopes``: lists of pieces that follow each other, ``i`` the place of the first."""
    at = F.sequence(F.lit(0), F.size("all") - 1, F.lit(LIST))
    return _cut(files).select("path", "all", F.explode(at).alias("i")).select("path", "i", F.slice("all", F.col("i") + 1, LIST).alias("t"))


def register(spark: SparkSession) -> None:
    """The SQL table function java_scopes: ``SELECT * FROM java_scopes(TABLE(pieces) PARTITION BY path ORDER BY i)``."""
    spark.udtf.register("java_scopes", F.udtf(scopes.ScopesOfPath, returnType=scopes.FIELDS))


def parse(files: DataFrame, with_code: bool = True) -> dict[str, DataFrame]:
    """Tables of the sources ``files`` (path, content), one row per path: classes, methods, variables, calls.

    Sources are read once, and what was found is written once, for the four tables
    to read. Without ``with_code`` the methods' text is null. Null and empty sources have no
    rows; bytes that aren't UTF-8 count as one replacement character each run.
    """
    told = pieces(files).select(F.when(F.col("i") == 0, F.col("path")).alias("path"), "i", "t")  # a file's name goes to the task once
    found = save(told.mapInArrow(lambda batches: scopes.follow(batches, with_code), scopes.FIELDS), "scopes")
    of = lambda kind: found.where(F.col("kind") == kind)
    return {
        "classes": of("class").select("path", "class_name", F.col("type").alias("kind")),
        "methods": of("method").select("path", "class_name", "name", F.col("n").alias("param_count"), F.when(F.col("type") == "array", "array").otherwise(naming.type_name(F.col("type"))).alias("return_type"), "start", "end", "code"),
        "variables": of("variable").select("path", "i", F.col("name").alias("var"), "type", "head"),
        "calls": of("call").select("path", "i", "caller", F.col("class_name").alias("caller_class"), F.col("name").alias("callee"), "callee_class", F.col("n").alias("arg_count"), F.col("field").alias("target_field"), "type", "start", "end"),
    }
