"""Java sources that say what a code graph says, written by Spark; reading them back must give the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import save
from .codegraph import CodeGraph


def ident(name):
    """A Java name: what isn't a letter, a digit or an underscore is dropped."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "")


def write(g: CodeGraph) -> DataFrame:
    """Rows (path, content): one source per class; every call stands in the method of its caller's least arity."""
    raw = save(g.raw_calls.distinct(), "raw-calls")  # read by the bodies and the fields
    values = lambda n: F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: i.cast("string")), ", ")
    target = F.when(F.col("type") == "internal", "").when(F.col("callee_class") == "Unknown", "ghost.").otherwise(F.concat(F.lit("f"), ident(F.col("callee_class")), F.lit(".")))
    call = F.concat(F.lit("    "), target, "callee", F.lit("("), values(F.col("arg_count")), F.lit("); // a call(1, 2)\n"))
    bodies = raw.withColumn("line", call).groupBy(F.col("caller_class").alias("class_name"), F.col("caller").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("body"))
    first = g.methods.groupBy("class_name", "name").agg(F.min("param_count").alias("param_count")).join(bodies, ["class_name", "name"], "left")
    params = F.array_join(F.transform(F.when(F.col("param_count") > 0, F.sequence(F.lit(1), F.col("param_count"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("int a"), i.cast("string"))), ", ")
    method = F.concat(F.lit("  /* void no(); */\n  public void "), "name", F.lit("("), params, F.lit(") {\n"), F.coalesce("body", F.lit("")), F.lit("  }\n"))
    text = g.methods.join(first, ["class_name", "name", "param_count"], "left").withColumn("m", method).groupBy("class_name").agg(F.array_join(F.sort_array(F.collect_list("m")), "").alias("methods"))
    used = raw.where("type = 'external' and callee_class <> 'Unknown'").select(F.col("caller_class").alias("class_name"), "callee_class").distinct()
    fields = used.groupBy("class_name").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("  @Autowired\n  private "), ident(F.col("callee_class")), F.lit(" f"), ident(F.col("callee_class")), F.lit(";\n")))), "").alias("fields"))
    rows = g.classes.select(F.col("name").alias("class_name"), F.col("file_path").alias("path"), "is_mapper").join(text, "class_name").join(fields, "class_name", "left")
    head = F.concat(F.lit("package com.acme;\nimport java.util.List;\n"), F.when(F.col("is_mapper"), "@Mapper\n").otherwise("@Service\n"), F.lit("public class "), ident(F.col("class_name")), F.lit(" {\n"))
    return rows.select("path", F.concat(head, F.coalesce("fields", F.lit("")), "methods", F.lit("}\n")).alias("content"))


def write_forms(g: CodeGraph) -> DataFrame:
    """Rows (path, content): for every pair of a class and a class it calls, a source with each form a receiver can have.

    Typed parameters, local variables, static calls, ``new``, a chain over a method's
    return type, an anonymous and a nested class, an unknown name, and an interface.
    """
    pair = g.raw_calls.where("callee_class <> 'Unknown'").select("caller_class", "callee_class").distinct()
    c, d = ident(F.col("caller_class")), ident(F.col("callee_class"))
    named = pair.select("caller_class", "callee_class", c.alias("c"), d.alias("d"))
    lines = (
        "interface Port{c}{d} {{ int send({d} first, int second); }}",
        "public class Use{c}{d} {{",
        "  public {d} make() {{ return new {d}(); }}",
        "  public void run({d} given, int n) {{",
        "    {d} local = new {d}(); // new Ghost().no();",
        "    local.one(1);",
        "    given.two(1, \"a, b\");",
        "    {d}.fixed();",
        "    new {d}().built(n);",
        "    make().chained();",
        "    ghost.lost(1, 2, 3);",
        "    Runner r = new Runner() {{ public void go() {{ local.inside(); }} }};",
        "  }}",
        "  class In{c}{d} {{ void deep({d} own) {{ own.nested(); }} }}",
        "}}",
    )
    text = "\n".join(lines).replace("{{", "\x01").replace("}}", "\x02").replace("{c}", "\x03").replace("{d}", "\x04")
    filled = F.lit(text)
    for mark, value in (("\x03", F.col("c")), ("\x04", F.col("d")), ("\x01", F.lit("{")), ("\x02", F.lit("}"))):
        filled = F.replace(filled, F.lit(mark), value)
    return named.select(F.concat(F.lit("/src/use/"), "c", "d", F.lit(".java")).alias("path"), filled.alias("content"))
