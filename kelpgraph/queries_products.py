"""More registered queries: products of the graph, reports, stored forms, and the sparse layout."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries as base
from .functions import fixed, naming
from .operators import chains, degrees, entries, inference, lexical, linking, quality, rag, traverse, trees, vectors
from .plans import codegraph
from .plans.codegraph import SPARSE_SQL, CodeGraph, from_tables, sparse
from .queries import _CATEGORY, _DIAGNOSED, _INFER, _J, _LAYERED, _LT, _METRICS, _T, CG, SQL, Q, _chains_of, _first, _levels, _order_chains, query
from .sources.tables import save, shared_dir, table

# --- inferred edges, in place of unknown ones --------------------------------------
_MERGED = _INFER + """
, u3 AS (SELECT u.* FROM u2 u WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.caller = u.caller AND p2.caller_class = u.caller_class AND p2.callee = u.callee)),
inf AS (SELECT caller, caller_class, callee, callee_class FROM p1 UNION SELECT caller, caller_class, callee, callee_class FROM p2
  UNION SELECT u.caller, u.caller_class, u.callee, n.class_name FROM u3 u JOIN cg_node n ON n.name = u.callee JOIN cg_class c ON c.name = n.class_name AND c.is_mapper),
rest AS (SELECT * FROM cg_unknown u WHERE NOT EXISTS (SELECT 1 FROM inf WHERE inf.caller = u.caller AND inf.caller_class = u.caller_class AND inf.callee = u.callee)),
whole AS (SELECT caller, caller_class, callee, callee_class, type FROM (SELECT * FROM cg_known UNION SELECT *, 'external' FROM inf) UNION ALL SELECT *, NULL, 'unknown' FROM rest)
"""


def _inferred(g: CodeGraph) -> DataFrame:
    return inference.infer(g.unknown, g.methods, g.classes)


@query(_MERGED + "SELECT * FROM whole")
def merged_calls(g: CodeGraph):
    """The edge table with inferred edges in place of the unknown ones they resolve."""
    return inference.merged(g.calls, _inferred(g))


@query(_MERGED + "SELECT DISTINCT callee AS name FROM cg_unknown WHERE callee NOT IN (SELECT callee FROM rest)")
def purged_externals(g: CodeGraph):
    """External methods that nothing unknown leads to after the inference."""
    return inference.purged_names(g.unknown, _inferred(g))


@query("""SELECT type, CASE WHEN callee_class = 'Unknown' OR l IS NULL THEN 'none' WHEN list_contains(l, arg_count) THEN 'exact' WHEN len(l) = 1 THEN 'fallback'
WHEN list_min(list_transform(l, lambda c: abs(c - arg_count))) <= 1 THEN 'tolerant' ELSE 'none' END AS mode, arg_count,
CASE WHEN mode = 'exact' THEN arg_count WHEN mode <> 'none' THEN list_min(list_transform(l, lambda c: struct_pack(o := abs(c - arg_count), c := c))).c END AS arity, count(*) AS n
FROM (SELECT DISTINCT * FROM cg_raw) r LEFT JOIN (SELECT class_name, name, list(param_count) AS l FROM cg_method GROUP BY ALL) s ON s.class_name = r.callee_class AND s.name = r.callee GROUP BY ALL""")
def tolerant_arities(g: CodeGraph):
    """Which arity each call is linked to if one argument more or less is allowed."""
    return linking.link(g.raw_calls, g.methods, tolerance=1).groupBy("type", "mode", "arg_count", "arity").agg(F.count("*").alias("n"))


# --- structure ---------------------------------------------------------------------
_ISO = ", iso AS (SELECT * FROM cg_node n WHERE NOT EXISTS (SELECT 1 FROM cg_calls c WHERE c.caller = n.name AND c.caller_class = n.class_name) AND NOT EXISTS (SELECT 1 FROM cg_known c WHERE c.callee = n.name AND c.callee_class = n.class_name))"


@query(_ISO + "SELECT (SELECT count(*) FROM cg_node) AS methods, (SELECT count(*) FROM iso) AS isolated")
def graph_integrity(g: CodeGraph):
    """A8."""
    return degrees.integrity(g.nodes, g.calls)


@query(_LT + " SELECT layer, count(*) AS classes, CAST(coalesce(sum(n_methods), 0) AS BIGINT) AS methods, coalesce(sum(n_methods) / count(*), 0)::DOUBLE AS mean_methods FROM lt GROUP BY layer UNION ALL SELECT NULL, count(*), CAST(coalesce(sum(n_methods), 0) AS BIGINT), coalesce(sum(n_methods) / count(*), 0)::DOUBLE FROM lt")
def tree_summary(g: CodeGraph):
    """Per layer and over all layers."""
    return trees.tree_summary(g.classes, g.nodes)


@query("SELECT class_name, list_sort(list(DISTINCT name)) AS methods FROM cg_method GROUP BY 1")
def merged_classes(g: CodeGraph):
    """Classes listed once per number of parameters become one, with the union of their methods."""
    listed = g.methods.groupBy("class_name", "param_count").agg(F.collect_list("name").alias("methods"))
    return trees.merged_classes(listed)


_PP = ", pk AS (SELECT name, ['com', 'acme', 'd' || (b % 5)] AS d, layer, 'B' || b AS leaf FROM cg_class), pp AS (SELECT name, CASE WHEN layer = 'misc' THEN list_concat(d, ['misc', leaf]) ELSE [layer, leaf] END AS p FROM pk)"


@query(_PP + ", hit AS (SELECT p, name IN (SELECT class_name FROM cg_node WHERE contains(lower(name), 'small')) AS m FROM pp) SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT p, m, unnest(range(1, len(p) + 1)) AS i FROM hit) WHERE m OR len(list_filter(p[i:], lambda x: contains(lower(x), 'small'))) > 0")
def package_search(g: CodeGraph):
    """what of the package tree has a match in it or below it."""
    return trees.package_search(g.classes, g.nodes, "small")


@query(_PP + " SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM pp) WHERE len(list_filter(p[i:], lambda x: contains(lower(x), 'b1'))) > 0")
def package_search_names(g: CodeGraph):
    """by the names of packages and classes."""
    return trees.package_search(g.classes, g.nodes, "B1")


@query(_LAYERED + "SELECT layer AS name, priority, count(DISTINCT name) AS classes FROM cg_layered GROUP BY 1, 2")
def layer_nodes(g: CodeGraph):
    """K10."""
    return trees.layer_nodes(g.classes)


@query(_LAYERED + "SELECT DISTINCT layer, name AS class_name FROM cg_layered")
def layer_contains(g: CodeGraph):
    """K10."""
    return trees.layer_contains(g.classes)


@query(_PP + " SELECT DISTINCT array_to_string(p[1 : len(p) - 1], '/') AS package, name AS class_name FROM pp")
def package_contains(g: CodeGraph):
    """K11."""
    return trees.package_contains(g.classes)


@query(_PP + " SELECT array_to_string(p[1 : len(p) - 1], '/') AS name, count(*) AS class_count, CAST(sum((SELECT count(*) FROM cg_node n WHERE n.class_name = pp.name)) AS BIGINT) AS method_count FROM pp GROUP BY 1")
def package_nodes(g: CodeGraph):
    """K11."""
    return trees.package_nodes(g.classes, g.nodes)


@query(base._whole(f", x AS (WITH {_levels(fixed.DEPTH, False)[2:]}) SELECT origin AS start_method, node AS end_method, depth FROM x"))
def call_paths(g: CodeGraph):
    """From every method of each controller, to the default depth."""
    return trees.call_paths(traverse.reach(traverse.keyed(g.known), base._all(g), fixed.DEPTH))


@query(base._whole(f", x AS (WITH {_levels(2, False)[2:]}) SELECT origin, via AS source, node AS target, type, type <> 'internal' AS dashed FROM x"))
def focus_view_edges(g: CodeGraph):
    """The edges of a drawing around every method of each controller."""
    return traverse.view(traverse.reach(traverse.keyed(g.known), base._all(g), 2), g.classes)[1]


@query(_LAYERED + base._whole(f", x AS (WITH {_levels(2, True)[2:]})") + f", e AS (SELECT origin, node, min(depth) AS depth FROM (SELECT origin, node, depth FROM x UNION ALL SELECT origin, origin, 0 FROM x) GROUP BY 1, 2) SELECT origin, node, CAST(depth AS INT) AS depth, coalesce(layer, 'other') AS layer FROM e LEFT JOIN cg_layered ON name = regexp_replace(node, '\\.[^.]*$', '')")
def focus_view_nodes(g: CodeGraph):
    """The nodes of the drawing of what calls every method of each controller."""
    return traverse.view(traverse.reach(traverse.keyed(g.known), base._all(g), 2, up=True), g.classes, up=True)[0]


@query(_T + """ SELECT root, '@startuml' || chr(10) || string_agg(CASE WHEN depth > 0 THEN regexp_replace(path[-2], '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(node, '[^A-Za-z0-9_]', '_', 'g') || chr(10) ELSE '' END
|| 'class "' || string_split(node, '.')[-1] || '" as ' || regexp_replace(node, '[^A-Za-z0-9_]', '_', 'g') || CASE WHEN type = 'external' THEN ' #pink' ELSE '' END, chr(10) ORDER BY path) || chr(10) || '@enduml' AS text FROM tree GROUP BY root""")
def plantuml_call_chain(g: CodeGraph):
    """K16, H7."""
    return trees.plantuml_calls(traverse.call_tree(traverse.keyed(g.known), _first(g).select(F.col("node").alias("root")), 3, 8))


@query(_PP + """, n AS (SELECT p, (SELECT count(*) FROM cg_node n WHERE n.class_name = pp.name) AS m FROM pp), i AS (SELECT DISTINCT p[1:k] AS p FROM (SELECT p, unnest(range(1, len(p))) AS k FROM pp)),
l AS (SELECT p AS key, repeat('  ', len(p) - 1) || 'class ' || p[-1] || ' {' || chr(10) || repeat('  ', len(p)) || '+ ' || m || ' methods' || chr(10) || repeat('  ', len(p) - 1) || '}' AS line FROM n
UNION ALL SELECT p, repeat('  ', len(p) - 1) || 'package "' || p[-1] || '" {' FROM i UNION ALL SELECT list_append(p, chr(65535)), repeat('  ', len(p) - 1) || '}' FROM i)
SELECT '@startuml' || chr(10) || 'skinparam packageStyle folder' || chr(10) || string_agg(line, chr(10) ORDER BY key, line) || chr(10) || '@enduml' AS text FROM l""")
def plantuml_package_tree(g: CodeGraph):
    """K16, H7."""
    return trees.plantuml_packages(g.classes, g.nodes)


SQL["tree_json"] = SQL["package_tree"]


@query()
def tree_json(g: CodeGraph):
    """The package tree written as JSON and read back from the first of two places that has one."""
    tree = trees.package_tree(g.classes)
    path = f"{shared_dir(g.classes.sparkSession)}/tree-{uuid.uuid4().hex}"
    trees.write_tree(tree, path)
    return trees.read_tree(g.classes.sparkSession, [f"{path}-none", path], tree.schema)


# --- reports -------------------------------------------------------------------------
def _report(g: CodeGraph, wanted: DataFrame) -> DataFrame:
    return quality.metrics(g.classes, g.nodes, g.calls, wanted)


def _now(spark, sf_dir) -> DataFrame:
    return _report(from_tables(spark, sf_dir), _order_chains(spark, sf_dir))


_R1 = f"WITH r AS (WITH {CG}{_METRICS})"
_R2 = f"{_R1}, r2 AS (WITH {SPARSE_SQL}{_METRICS})"


@query(f"""{_R1} SELECT * FROM (SELECT metric, value, CASE WHEN metric = 'broken_chain_rate' AND value > 0.35 THEN 'resolve unknown calls first' WHEN metric = 'reachability_rate' AND value < 0.5 THEN 'add entry rules or depth'
WHEN metric = 'isolated_method_ratio' AND value > 0.2 THEN 'check methods without edges' WHEN metric = 'layer_violation_rate' AND value > 0.05 THEN 'review calls across layers' END AS hint FROM r) WHERE hint IS NOT NULL""", graph=False)
def report_hints(spark, sf_dir):
    """A32."""
    return quality.hints(_now(spark, sf_dir))


@query(f"{_R2} SELECT r.metric, r2.value AS previous, r.value, r.value - r2.value AS delta FROM r JOIN r2 ON r2.metric = r.metric", graph=False)
def metric_changes(spark, sf_dir):
    """Q2, Q4: the report of the graph against that of the sparse layout."""
    return quality.change(_now(spark, sf_dir), _report(sparse(spark, sf_dir), _chains_of(*codegraph.sparse_tables(spark, sf_dir))))


@query(f"{_R2} SELECT r.metric, r2.value AS previous, r.value, r.value - r2.value AS delta FROM r JOIN r2 ON r2.metric = r.metric ORDER BY abs(delta) DESC, r.metric LIMIT 5", graph=False)
def top_metric_changes(spark, sf_dir):
    """Q3, T8."""
    return quality.top_changes(metric_changes(spark, sf_dir))


_CATALOGUE = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + f", {i})" for i, row in enumerate(fixed.CATALOGUE))
_SHOWN = "CASE WHEN shown = 'percent' THEN printf('%.4f %%', value * 100) ELSE printf('%.0f', value) END"


@query(f"""{_R2} SELECT k.metric, better, meaning, r.value, r2.value AS previous, r.value - r2.value AS delta, CASE WHEN r.value = r2.value OR better = 'neutral' THEN 'same' WHEN (r.value > r2.value) = (better = 'higher') THEN 'better' ELSE 'worse' END AS trend,
{_SHOWN.replace('value', 'r.value')} AS text FROM (VALUES {_CATALOGUE}) k(metric, better, shown, meaning, place) LEFT JOIN r ON r.metric = k.metric LEFT JOIN r2 ON r2.metric = k.metric""", graph=False)
def explain_metrics(spark, sf_dir):
    """Every metric with its meaning and its change."""
    return quality.explain(_now(spark, sf_dir), _report(sparse(spark, sf_dir), _chains_of(*codegraph.sparse_tables(spark, sf_dir))))


@query(f"{_R1} SELECT 'Quality report' || chr(10) || string_agg(rpad(k.metric, 32, ' ') || {_SHOWN}, chr(10) ORDER BY place) AS text FROM (VALUES {_CATALOGUE}) k(metric, better, shown, meaning, place) JOIN r ON r.metric = k.metric", graph=False)
def report_text(spark, sf_dir):
    """K18, C11."""
    return quality.report_text(_now(spark, sf_dir))


@query(f"{_R1} SELECT 'run-1' AS run_id, metric, value FROM r", graph=False)
def stored_report(spark, sf_dir):
    """The report as a nested record, written, and read back key by key."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    quality.record(_now(spark, sf_dir), "run-1").write.parquet(path)
    run = spark.read.parquet(path).select(quality.value_at("json", "run_id").alias("run_id"))
    return quality.load_report(spark, path).join(run).select("run_id", "metric", "value")


@query(base._ENTRY + "SELECT name, class_name FROM entry e WHERE NOT EXISTS (SELECT 1 FROM cg_known k WHERE k.caller = e.name AND k.caller_class = e.class_name AND k.type = 'internal')")
def entries_without_internal(g: CodeGraph):
    """A31, over internal calls only."""
    return entries.without_downstream(entries.entries(g.nodes, g.classes, g.calls), g.known.where("type = 'internal'"))


# --- chains ----------------------------------------------------------------------------
@query("""SELECT CAST(l_orderkey AS VARCHAR) AS name, array_to_string(list(p_brand || '.' || replace(p_name, ' ', '_') ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_brand, p_name), ' > ') AS hops
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 7 <> 0 AND l_partkey % 9 <> 0 GROUP BY l_orderkey HAVING count(*) >= 2""", graph=False)
def normalised_chains(spark, sf_dir):
    """Chains from JSON hops, pairs and objects mixed; chains without a name and hops that name nothing are dropped."""
    keys = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "p_brand", "p_name")
    named = F.struct(F.col("p_brand").alias("class"), F.translate("p_name", " ", "_").alias("method"))
    pair = F.to_json(F.array(F.concat(F.lit(" "), F.col("p_brand")), F.concat(F.translate("p_name", " ", "_"), F.lit(" "))))
    hop = F.when(F.col("l_partkey") % 9 == 0, F.lit('{"class": "", "method": "x"}')).when(F.col("l_partkey") % 2 == 0, F.to_json(named)).otherwise(pair)
    name = F.when(F.col("l_orderkey") % 7 == 0, "").otherwise(F.col("l_orderkey").cast("string"))
    raw = keys.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), hop.alias("hop")))).alias("h")).select(name.alias("name"), F.transform("h", lambda x: x["hop"]).alias("hops"))
    return chains.normalised(raw).select("name", F.array_join(F.transform("hops", lambda h: F.concat_ws(".", h["class"], h["method"])), " > ").alias("hops"))


# --- chunks and recall --------------------------------------------------------------------
_CHUNKS = SQL["chunks"].split("SELECT concat_ws('::'", 1)
_CHUNK = f"{_CHUNKS[0]}, chunk AS (SELECT concat_ws('::'{_CHUNKS[1]})"


def _stored(g: CodeGraph) -> DataFrame:
    return vectors.chunks(g.nodes, g.classes, g.calls).where("layer = 'util'")


def _short(c, m):
    """A summariser that has nothing to say of names with an e in second place."""
    return F.when(F.substring(m, 2, 1) != "e", F.concat(F.lit("Method "), m, F.lit(" of "), c))


@query()
def index_statistics(g: CodeGraph):
    """An index run over all chunks, those of one layer being stored and some failing."""
    return vectors.index_run(vectors.chunks(g.nodes, g.classes, g.calls, _short, failed=True), _stored(g))[1]


SQL["index_statistics"] = f"{_CHUNK} SELECT count(*) AS total, count(*) FILTER (layer <> 'util' AND substring(method_name, 2, 1) <> 'e') AS indexed, count(*) FILTER (layer = 'util') AS skipped, count(*) FILTER (layer <> 'util' AND substring(method_name, 2, 1) = 'e') AS failed FROM chunk"


@query()
def indexed_chunks(g: CodeGraph):
    """V4: what is stored after that run."""
    return vectors.index_run(vectors.chunks(g.nodes, g.classes, g.calls, _short, failed=True), _stored(g))[0].select("id", "summary", "layer")


SQL["indexed_chunks"] = f"{_CHUNK} SELECT id, summary, layer FROM chunk WHERE layer = 'util' OR substring(method_name, 2, 1) <> 'e'"


@query()
def chunks_to_index(g: CodeGraph):
    """Of the hundred most called methods those that aren't stored."""
    return vectors.to_index(vectors.chunks(g.nodes, g.classes, g.calls), _stored(g), 100).select("id", "callers_count")


SQL["chunks_to_index"] = f"{_CHUNK} SELECT id, callers_count FROM (SELECT * FROM chunk ORDER BY callers_count DESC, id LIMIT 100) WHERE layer <> 'util'"


@query()
def index_priority(g: CodeGraph):
    """The twenty chunks that come first by raw calls, for keys in full and for bare names."""
    n = g.raw_calls.where("callee_class <> 'Unknown'").groupBy(naming.method_key(F.col("callee_class"), F.col("callee")).alias("key")).agg(F.count("*").alias("n"))
    bare = g.raw_calls.where("callee_class = 'Unknown'").groupBy(F.col("callee").alias("key")).agg(F.count("*").alias("n"))
    return vectors.prioritised(vectors.chunks(g.nodes, g.classes, g.calls), n.unionByName(bare), 20).select("id", "n")


SQL["index_priority"] = f"{_CHUNK}, hot AS (SELECT CASE WHEN callee_class = 'Unknown' THEN callee ELSE callee_class || '.' || callee END AS key, count(*) AS n FROM cg_raw GROUP BY 1), k AS (SELECT *, class_name || '.' || method_name AS key FROM chunk), a AS (SELECT id, n FROM k JOIN hot USING (key) UNION ALL SELECT id, n FROM hot h JOIN k ON k.method_name = string_split(h.key, '.')[-1] WHERE h.key NOT IN (SELECT key FROM k)) SELECT id, max(n) AS n FROM a GROUP BY id ORDER BY n DESC, id LIMIT 20"


@query()
def stored_chunks(g: CodeGraph):
    """Which chunks are stored, and how many."""
    return vectors.stored_ids(_stored(g), vectors.chunks(g.nodes, g.classes, g.calls))


SQL["stored_chunks"] = f"{_CHUNK} SELECT id, layer = 'util' AS there, (SELECT count(*) FROM chunk WHERE layer = 'util') AS stored FROM chunk"


@query("SELECT DISTINCT class_name || '.' || name AS key, class_name, name AS method FROM cg_method UNION SELECT name, NULL, name FROM cg_method")
def split_keys(g: CodeGraph):
    """keys taken apart at their first dot; bare names have no class."""
    keys = g.nodes.select(naming.method_key(F.col("class_name"), F.col("name")).alias("key")).union(g.nodes.select("name")).distinct()
    cls, method = naming.class_and_method(F.col("key"))
    return keys.select("key", cls.alias("class_name"), method.alias("method"))


_HITS = """, vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
near AS (SELECT query_id, v.vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - q[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q[i]::DOUBLE))), v.vec_id) AS INT) AS rank FROM embeddings v, vq QUALIFY rank <= 2),
hit0 AS (SELECT query_id, p_brand || '.' || replace(p_name, ' ', '_') AS node, min(rank) AS first FROM near JOIN part ON p_partkey = vec_id GROUP BY 1, 2), hit AS (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY first, node) AS rank FROM hit0)"""
_FROM_HITS = ", src AS (SELECT DISTINCT node AS origin FROM hit)"


def _around(up: bool) -> str:
    return base._levels(2, up).replace(base._FIRST, _FROM_HITS)[2:]


@query(f"WITH {CG}{_HITS}, dn AS (WITH {_around(False)}), up AS (WITH {_around(True)}), z AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, node) AS r FROM (SELECT origin, depth, node FROM dn UNION SELECT origin, depth, node FROM up)), body AS (SELECT origin, string_agg('  ' || depth || ' ' || node, chr(10) ORDER BY r) AS body FROM z WHERE r <= 30 GROUP BY 1) SELECT query_id, string_agg('# ' || node || coalesce(chr(10) || body, ''), chr(10) ORDER BY rank) AS context, array_to_string(list_sort(list(DISTINCT node)), ',') AS refs FROM hit LEFT JOIN body ON origin = node GROUP BY query_id", graph=False)
def rag_search(spark, sf_dir):
    """The two nearest vectors of each query, the methods they stand for, and what lies two calls around these."""
    g = from_tables(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    owners = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), naming.method_key(F.col("p_brand"), F.translate("p_name", " ", "_")).alias("node"))
    found = save(vectors.hits(vectors.top_k(v, asked, 2), owners), "hits")
    return rag.around_hits(g, found)


# --- questions as text ---------------------------------------------------------------------------
def _terms_sql(text: str) -> str:
    """The same parts of identifiers as ``lexical.terms``."""
    spaced = f"regexp_replace(regexp_replace(coalesce({text}, ''), '(\\p{{Ll}}|\\p{{N}})(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"list_transform(regexp_extract_all({spaced}, '\\p{{L}}+|\\p{{N}}+'), lambda x: lower(x))"


def _ranked_sql(k: int, on: str = "") -> str:
    """Every document scored for every question: txt (id, text), ask (query_id, text)."""
    return f"""tf AS (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest({_terms_sql('text')}) AS t FROM txt) GROUP BY ALL),
li AS (SELECT t, ln(((SELECT count(*) FROM txt) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY t),
aq AS (SELECT DISTINCT query_id, unnest({_terms_sql('text')}) AS t FROM ask),
sc AS (SELECT query_id, tf.id, round(sum(idf * tf / (tf + 1.2)), 6) AS score FROM aq JOIN tf ON tf.t = aq.t JOIN li ON li.t = aq.t {on} GROUP BY query_id, tf.id),
ra AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM sc QUALIFY rank <= {k})"""


_TURNS = "WITH txt AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role <> 'user'), ask AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' AND conv_id % 20 = 0), "


def _turns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    talk = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    return talk.where("role <> 'user'").select(key.alias("id"), "text"), talk.where("role = 'user' and conv_id % 20 = 0").select(key.alias("query_id"), "text")


@query(_TURNS + _ranked_sql(10) + " SELECT * FROM ra", graph=False)
def question_search(spark, sf_dir):
    """The ten best answers, among all turns that aren't a user's, for the users' turns of every conversation whose id is divisible by 20."""
    texts, asked = _turns(spark, sf_dir)
    return lexical.TextIndex(texts).search(asked, 10)


_PART_ASK = "ask AS (SELECT p_partkey AS query_id, 'Where is the ' || p_name || ' of ' || p_brand || ' used?' AS text FROM part WHERE p_partkey % 20 = 0)"
_METHOD_TEXT = ", txt AS (SELECT class_name || '.' || name AS id, 'Method ' || name || ' of ' || class_name AS text FROM cg_node)"


def _part_questions(spark, sf_dir) -> DataFrame:
    asked = F.concat(F.lit("Where is the "), "p_name", F.lit(" of "), "p_brand", F.lit(" used?"))
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), asked.alias("text"))


@query(f"WITH {CG}{_METHOD_TEXT}, {_PART_ASK}, {_ranked_sql(5)} SELECT * FROM ra", graph=False)
def question_methods(spark, sf_dir):
    """V6, V8: questions about every part whose key is divisible by 20; the five methods whose identifiers answer them best."""
    return rag.recall(from_tables(spark, sf_dir), _part_questions(spark, sf_dir), 5)


_LAYER_ASK = "ly AS (SELECT DISTINCT class_name || '.' || n.name AS id, layer FROM cg_node n JOIN cg_layered l ON l.name = class_name), ask AS (SELECT DISTINCT layer AS query_id, layer || ' ring bolt gear' AS text FROM ly)"


@query(f"{_LAYERED}{_METHOD_TEXT}, {_LAYER_ASK}, {_ranked_sql(30, 'JOIN ly ON ly.id = tf.id AND ly.layer = query_id')} SELECT query_id AS layer, string_agg('- ' || id || ': ' || text, chr(10) ORDER BY rank) AS samples FROM ra JOIN (SELECT DISTINCT * FROM txt) USING (id) GROUP BY query_id")
def describe_layers(g: CodeGraph):
    """Per layer the thirty methods of that layer that a question about it recalls."""
    return rag.describe(g)


@query(base._whole(_levels(6, False)).replace("SELECT origin, node, depth, e[2] AS type, e[1] AS via FROM r6", "SELECT origin, CAST(row_number() OVER (PARTITION BY origin ORDER BY depth, node) AS INT) AS n, '[' || depth || '] ' || e[1] || ' -> ' || node || ' (' || e[2] || ')' AS line FROM r6"))
def trace_entries(g: CodeGraph):
    """V9: the trace of every method of the controllers, six calls deep."""
    return rag.trace(g, base._all(g))


@query(f"WITH {CG}{_METHOD_TEXT}, {_PART_ASK}, {_ranked_sql(2)}, hit AS (SELECT query_id, id AS node, rank FROM ra), dn AS (WITH {base._levels(2, False).replace(base._FIRST, ', src AS (SELECT DISTINCT node AS origin FROM hit)')[2:]}), up AS (WITH {base._levels(2, True).replace(base._FIRST, ', src AS (SELECT DISTINCT node AS origin FROM hit)')[2:]}), z AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, node) AS r FROM (SELECT origin, depth, node FROM dn UNION SELECT origin, depth, node FROM up)), body AS (SELECT origin, string_agg('  ' || depth || ' ' || node, chr(10) ORDER BY r) AS body FROM z WHERE r <= 30 GROUP BY 1) SELECT query_id, string_agg('# ' || node || coalesce(chr(10) || body, ''), chr(10) ORDER BY rank) AS context, array_to_string(list_sort(list(DISTINCT node)), ',') AS refs FROM hit LEFT JOIN body ON origin = node GROUP BY query_id", graph=False)
def question_answers(spark, sf_dir):
    """V8: questions about parts; the two methods each recalls best, with what lies two calls around these."""
    return rag.answer(from_tables(spark, sf_dir), _part_questions(spark, sf_dir), 2)


# --- documents as ordered files ------------------------------------------------------------------
def _filed(lines: DataFrame, order: list[str]) -> DataFrame:
    """The lines of the part files that an ordered document was written to."""
    from .sources.sinks import read_ordered, write_ordered

    spark = lines.sparkSession
    path = f"{shared_dir(spark)}/document-{uuid.uuid4().hex}"
    write_ordered(lines, path, order)
    return read_ordered(spark, path)


@query(SQL["architecture_doc"].removeprefix(f"WITH {CG}").replace(" SELECT '# Architecture'", ", whole AS (SELECT '# Architecture'") + "), part AS (SELECT string_split(text, chr(10)) AS s FROM whole) SELECT unnest(range(1, len(s) + 1)) AS n, unnest(s) AS line FROM part")
def architecture_files(g: CodeGraph):
    """The architecture document written as ordered files; their lines are those of the one text."""
    return _filed(trees.architecture_lines(g.classes, g.nodes), ["a", "b", "c"])


@query(""", pk AS (SELECT name, ['com', 'acme', 'd' || (b % 5)] AS d, layer, 'B' || b AS leaf FROM cg_class), pp AS (SELECT name, CASE WHEN layer = 'misc' THEN list_concat(d, ['misc', leaf]) ELSE [layer, leaf] END AS p FROM pk),
inn AS (SELECT p[1:i] AS p, CASE WHEN bool_or(i < len(p)) THEN 'package' ELSE 'class' END AS kind FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM pp) GROUP BY p[1:i]),
ev AS (SELECT * FROM inn UNION SELECT list_append(p, m.name), 'method' FROM pp JOIN cg_node m ON m.class_name = pp.name WHERE list_append(p, m.name) NOT IN (SELECT p FROM inn)),
dl AS (SELECT p AS key, CASE WHEN p = min(p) OVER (PARTITION BY p[1:len(p) - 1]) THEN '' ELSE ',' END || '{"name":"' || p[-1] || '","kind":"' || kind || CASE WHEN kind = 'method' THEN '"}' ELSE '","children":[' END AS line FROM ev
UNION ALL SELECT list_append(p, chr(65535)), ']}' FROM inn UNION ALL SELECT CAST([] AS VARCHAR[]), '[' UNION ALL SELECT [chr(65535)], ']') SELECT row_number() OVER (ORDER BY key) AS n, line FROM dl""")
def tree_document(g: CodeGraph):
    """Packages, classes and methods as nested JSON of any depth, written as ordered files."""
    return _filed(trees.document_lines(g.classes, g.nodes), ["key"])


# --- extraction --------------------------------------------------------------------------------
_PAIRS = ", pr AS (SELECT DISTINCT " + _J.format("caller_class") + " AS c, " + _J.format("callee_class") + " AS d FROM cg_raw WHERE callee_class <> 'Unknown')"


def _forms(g: CodeGraph) -> dict[str, DataFrame]:
    from .operators.extract import parse
    from .plans.sources_of_graph import write_forms

    return parse(save(write_forms(g), "forms"), with_code=False)


_CALLED = (("one", "d", 1), ("two", "d", 2), ("fixed", "d", 0), ("built", "d", 1), ("chained", "d", 0), ("lost", "'Unknown'", 3), ("inside", "d", 0))


@query(_PAIRS + " " + " UNION ALL ".join(f"SELECT 'run' AS caller, 'Use' || c || d AS caller_class, '{m}' AS callee, {t} AS callee_class, {n} AS arg_count, 'external' AS type FROM pr" for m, t, n in _CALLED) + " UNION ALL SELECT 'run', 'Use' || c || d, 'make', 'Use' || c || d, 0, 'internal' FROM pr UNION ALL SELECT 'deep', 'In' || c || d, 'nested', d, 0, 'external' FROM pr")
def extract_receivers(g: CodeGraph):
    """Receivers that are parameters, locals, static, new, a method's result, anonymous, nested and unknown."""
    return _forms(g)["calls"].select("caller", "caller_class", "callee", "callee_class", "arg_count", "type")


@query(_PAIRS + " SELECT 'Use' || c || d AS class_name, 'make' AS name, 0 AS param_count, d AS return_type FROM pr UNION ALL SELECT 'Use' || c || d, 'run', 2, 'void' FROM pr UNION ALL SELECT 'In' || c || d, 'deep', 1, 'void' FROM pr UNION ALL SELECT 'Port' || c || d, 'send', 2, 'int' FROM pr")
def extract_returns(g: CodeGraph):
    """Methods of classes, nested classes and interfaces with what they return."""
    return _forms(g)["methods"].select("class_name", "name", "param_count", "return_type")


@query(_PAIRS + " SELECT '/src/use/' || c || d || '.java' AS path, var, d AS type FROM pr, (VALUES ('first'), ('given'), ('local'), ('own')) v(var) UNION ALL SELECT '/src/use/' || c || d || '.java', 'r', 'Runner' FROM pr")
def extract_variables(g: CodeGraph):
    """Typed parameters and local variables."""
    return _forms(g)["variables"].select("path", "var", "type")


@query(_PAIRS + " SELECT '/src/use/' || c || d || '.java' AS path, k || c || d AS class_name, kind FROM pr, (VALUES ('Port', 'interface'), ('Use', 'class'), ('In', 'class')) v(k, kind)")
def extract_kinds(g: CodeGraph):
    """Classes, nested classes and interfaces."""
    return _forms(g)["classes"].select("path", "class_name", "kind")


@query(_MERGED + "SELECT caller, " + _J.format("caller_class") + " AS caller_class, callee, " + _J.format("callee_class") + " AS callee_class, type FROM whole")
def incremental_build(g: CodeGraph):
    """Sources built in an older state, then built again after files were changed, added and removed; the graph that is stored."""
    from .plans import build
    from .plans.sources_of_graph import write
    from .sources.files import hashed

    spark = g.classes.sparkSession
    now = save(hashed(write(g)), "sources-now")
    old = F.when(F.col("path").contains("/dal/"), F.lit("class Before { void none() { gone.x(); } }")).otherwise(F.col("content"))
    more = spark.range(1).select(F.lit("/src/main/java/com/acme/Gone.java").alias("path"), F.lit("class Gone { void small() { ghost.small(); } }").alias("content"))
    before = save(hashed(now.where(~F.col("path").contains("/util/")).select("path", old.alias("content")).unionByName(more)), "sources-before")
    out = f"{shared_dir(spark)}/build-{uuid.uuid4().hex}"
    build.build_from(before, out, incremental=True)
    build.build_from(now, out, incremental=True)
    return build.load(spark, out).calls


# --- the sparse layout ------------------------------------------------------------------------
_PLAIN = f"WITH {CG}"
for _name in ("infer_unique", "infer_proximity", "infer_mapper", "merged_calls", "isolated_methods", "cross_prefix", "prefix_distribution", "link_modes", "calls_table", "graph_integrity", "structure_diagnostics", "layer_violations"):
    assert SQL[_name].startswith(_PLAIN)
    SQL[f"{_name}_sparse"] = f"WITH {SPARSE_SQL}{SQL[_name][len(_PLAIN):]}"


def _on_sparse(f):
    return lambda spark, sf_dir: f(sparse(spark, sf_dir))


Q |= {
    f"{f.__name__}_sparse": _on_sparse(f)
    for f in (
        base.infer_unique, base.infer_proximity, base.infer_mapper, merged_calls, base.isolated_methods, base.cross_prefix, base.prefix_distribution,
        base.link_modes, base.calls_table, graph_integrity, base.structure_diagnostics, base.layer_violations,
    )
}

# The whole jobs also under the plain names.
for _name in ("downstream", "upstream", "data_flow_path", "vector_topk", "vector_topk_filtered", "rag_context"):
    Q[_name], SQL[_name] = Q[f"{_name}_every"], SQL[f"{_name}_every"]
