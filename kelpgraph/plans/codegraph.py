"""The code graph over the given tables: parts are methods, brands classes, consecutive order lines calls.

"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import inference, linking
from ..sources.tables import save, table


@dataclass(frozen=True)
class CodeGraph:
    """classes, methods and raw_calls, and the links and edges that follow from them."""

    classes: DataFrame
    methods: DataFrame
    raw_calls: DataFrame
    #: Edges that the inference passes found (J8-J11); they count as external calls.
    inferred: DataFrame | None = None

    @cached_property
    def links(self) -> DataFrame:
        return linking.link(self.raw_calls, self.methods)

    @cached_property
    def calls(self) -> DataFrame:
        """Every product reads the edges several times; they are derived once and written."""
        found = save(linking.edges(linking.linked(self.raw_calls, self.methods)), "calls")
        return found if self.inferred is None else inference.merged(found, self.inferred)

    @cached_property
    def known(self) -> DataFrame:
        return self.calls.where("type <> 'unknown'")

    @cached_property
    def unknown(self) -> DataFrame:
        return self.calls.where("type = 'unknown'").select("caller", "caller_class", "callee")

    @cached_property
    def nodes(self) -> DataFrame:
        """Methods by their key (name, class_name)."""
        return self.methods.select("name", "class_name").distinct()


def from_tables(spark: SparkSession, sf_dir: str) -> CodeGraph:
    return graph(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))


def sparse_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    number = F.substring("p_brand", 7, 9)
    begin = F.get(F.array(F.lit("BLord#"), F.lit("UIord#"), F.lit("DBord#")), number.cast("int") % 3)
    single = F.col("p_partkey") % 50 == 0
    part = part.withColumns({"p_name": F.when(single, F.concat_ws(" ", "p_name", "p_partkey")).otherwise(F.col("p_name")), "p_brand": F.concat(begin, number)})
    return part, lines.where("l_partkey % 100 <> 0")


def sparse(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The same layout with what it lacks otherwise: names that one class defines, methods without calls, telling class names, methods and classes without each other."""
    g = graph(*sparse_tables(spark, sf_dir))
    return CodeGraph(g.classes.where(~F.col("name").endswith("#55")), g.methods.where(~F.col("class_name").endswith("#53")), g.raw_calls)


def graph(part: DataFrame, lines: DataFrame) -> CodeGraph:
    number = F.substring("p_brand", 7, 9).try_cast("int")  # the optimizer may evaluate it on other names
    names = F.array(*map(F.lit, ("controller", "service", "facade", "biz", "dal", "model", "util", "misc")))
    # The number is an aggregate: a filter on the paths and layers that follow from it is asked once a class.
    # As an expression of the name the optimizer would ask it of every part, here and on the other side of joins by name.
    classes = part.groupBy(F.col("p_brand").alias("name")).agg(F.max(number).alias("b")).withColumn("layer", F.get(names, F.col("b") % 8))
    path = F.concat(F.lit("/src/main/java/com/acme/d"), (F.col("b") % 5).cast("string"), F.lit("/"), "layer", F.lit("/B"), F.col("b").cast("string"), F.lit(".java"))
    classes = classes.select("name", path.alias("file_path"), "layer", (F.col("layer") == "dal").alias("is_mapper"))
    method = F.translate("p_name", " ", "_")
    methods = part.select(method.alias("name"), F.col("p_brand").alias("class_name"), (F.col("p_size") % 4).alias("param_count")).distinct()

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), (F.col("l_quantity").cast("int") % 4).alias("arg_count")).where("dst is not null")
    named = part.select("p_partkey", method.alias("name"), F.col("p_brand").alias("class_name"))
    a = named.select(F.col("p_partkey").alias("src"), F.col("name").alias("caller"), F.col("class_name").alias("caller_class"))
    b = named.select(F.col("p_partkey").alias("dst"), F.col("name").alias("callee"), F.col("class_name").alias("brand"))
    unresolved = (F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0
    raw = pairs.join(a, "src").join(b, "dst").select(
        "caller", "caller_class", "callee", F.when(unresolved, "Unknown").otherwise(F.col("brand")).alias("callee_class"), "arg_count",
        F.when((F.col("caller_class") == F.col("brand")) & ~unresolved, "internal").otherwise("external").alias("type"),
    )
    return CodeGraph(classes, methods, raw)


#: The same tables in SQL, for the twins of the queries.
SQL = """
cg_class AS (
  SELECT name, concat('/src/main/java/com/acme/d', CAST(b % 5 AS VARCHAR), '/', layer, '/B', CAST(b AS VARCHAR), '.java') AS file_path, layer, layer = 'dal' AS is_mapper, b
  FROM (SELECT name, b, CASE b % 8 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'facade' WHEN 3 THEN 'biz' WHEN 4 THEN 'dal' WHEN 5 THEN 'model' WHEN 6 THEN 'util' ELSE 'misc' END AS layer
        FROM (SELECT DISTINCT p_brand AS name, CAST(substring(p_brand, 7, 9) AS INT) AS b FROM part))),
cg_method AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name, p_brand AS class_name, p_size % 4 AS param_count FROM part),
cg_node AS (SELECT DISTINCT name, class_name FROM cg_method),
cg_pair AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
    CAST(l_quantity AS INT) % 4 AS arg_count FROM lineitem) WHERE dst IS NOT NULL),
cg_raw AS (SELECT replace(a.p_name, ' ', '_') AS caller, a.p_brand AS caller_class, replace(b.p_name, ' ', '_') AS callee,
    CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN 'Unknown' ELSE b.p_brand END AS callee_class, arg_count,
    CASE WHEN a.p_brand = b.p_brand AND (l_orderkey + l_linenumber) % 5 <> 0 THEN 'internal' ELSE 'external' END AS type
  FROM cg_pair JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey),
cg_sig AS (SELECT class_name, name, count(*) AS n_arity FROM cg_method GROUP BY class_name, name),
cg_link AS (SELECT r.*, CASE WHEN callee_class = 'Unknown' OR s.name IS NULL THEN 'none' WHEN m.name IS NOT NULL THEN 'exact' WHEN s.n_arity = 1 THEN 'fallback' ELSE 'none' END AS mode
  FROM (SELECT DISTINCT * FROM cg_raw) r LEFT JOIN cg_sig s ON s.class_name = r.callee_class AND s.name = r.callee
  LEFT JOIN cg_method m ON m.class_name = r.callee_class AND m.name = r.callee AND m.param_count = r.arg_count),
cg_known AS (SELECT DISTINCT caller, caller_class, callee, callee_class, type FROM cg_link WHERE mode <> 'none'),
cg_unknown AS (SELECT DISTINCT caller, caller_class, callee FROM cg_link WHERE mode = 'none' AND type = 'external'),
cg_calls AS (SELECT * FROM cg_known UNION ALL SELECT caller, caller_class, callee, NULL, 'unknown' FROM cg_unknown),
cg_edge AS (SELECT DISTINCT concat_ws('.', caller_class, caller) AS s, concat_ws('.', callee_class, callee) AS d FROM cg_known)
"""

#: The sparse layout in SQL: the two given tables are shadowed, and two conditions added.
SPARSE_SQL = """
part AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) ELSE p_name END AS p_name,
    concat(CASE CAST(substring(p_brand, 7, 9) AS INT) % 3 WHEN 0 THEN 'BLord#' WHEN 1 THEN 'UIord#' ELSE 'DBord#' END, substring(p_brand, 7, 9)) AS p_brand, p_size FROM main.part),
lineitem AS (SELECT * FROM main.lineitem WHERE l_partkey % 100 <> 0),""" + SQL.replace(" AS b FROM part)", " AS b FROM part WHERE NOT ends_with(p_brand, '#55'))").replace("AS param_count FROM part)", "AS param_count FROM part WHERE NOT ends_with(p_brand, '#53'))")
