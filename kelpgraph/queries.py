"""

``Q`` holds the queries, ``SQL`` the twins; a query without a twin can't be said in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed, naming
from .operators import chains, degrees, entries, inference, linking, quality, rag, taxonomy, traverse, trees, vectors
from .plans.codegraph import SQL as CG
from .plans.codegraph import CodeGraph, from_tables
from .sources import files, sinks
from .sources.tables import save, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = True):
    """Register a function of the graph (or of session and folder) under its name; ``sql`` follows the graph's own tables."""

    def register(f):
        Q[f.__name__] = (lambda spark, sf_dir: f(from_tables(spark, sf_dir))) if graph else f
        if sql is not None:
            SQL[f.__name__] = f"WITH {CG}{sql}" if graph else sql
        return f

    return register


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


# Fragments of the twins: the naming rules in SQL.
_LAYER = "CASE " + " ".join(f"WHEN contains(p, '/{n}/') OR ends_with(p, '/{n}') OR ends_with(p, '/{n}.java') THEN '{n}'" for n in fixed.LAYER_PRIORITY) + " ELSE 'other' END"
_PRIORITY = "CASE layer " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in fixed.LAYER_PRIORITY.items()) + " ELSE 99 END"
_DOMAIN = f"coalesce(list_filter(list_transform(string_split(file_path, '/')[:-2], lambda x: lower(x)), lambda x: x NOT IN ({_in(fixed.DOMAIN_SKIP)}))[-1], 'other')"


def _bucket(path: str, cls: str) -> str:
    out = "CASE "
    for b, names in fixed.BUCKET_PATHS.items():
        out += "WHEN " + " OR ".join(f"contains(lower({path}), '/{n}/')" for n in names) + f" THEN '{b}' "
    for b, names in fixed.BUCKET_ENDS.items():
        tests = [f"ends_with(lower({cls}), '{n}')" for n in names] + [f"starts_with(lower({cls}), '{n}')" for n in fixed.BUCKET_BEGINS[b]]
        out += "WHEN " + " OR ".join(tests) + f" THEN '{b}' "
    return out + "ELSE 'other' END"


_LAYERED = f", cg_layered AS (SELECT name, file_path, layer, domain, bucket, CAST({_PRIORITY} AS INT) AS priority FROM (SELECT name, file_path, {_LAYER} AS layer, {_DOMAIN} AS domain, {_bucket('file_path', 'name')} AS bucket FROM (SELECT *, lower(file_path) AS p FROM cg_class)))"
_OUT = ", outd AS (SELECT n.name, n.class_name, count(c.caller) AS out_degree FROM cg_node n LEFT JOIN cg_calls c ON c.caller = n.name AND c.caller_class = n.class_name GROUP BY ALL)"
_IN = ", ind AS (SELECT n.name, n.class_name, count(c.caller) AS in_degree FROM cg_node n LEFT JOIN cg_known c ON c.callee = n.name AND c.callee_class = n.class_name GROUP BY ALL)"
_RULES = [
    ("layer.controller_action", 8, "layer IN ('controller', 'action')"),
    ("path.entry_like_segment", 4, "regexp_matches(lower(file_path), '/(interf|interface|api|web|struts|job|batch|task|schedule)/')"),
    ("class.suffix_action_controller", 8, "regexp_matches(lower(class_name), '(action|controller)$')"),
    ("class.suffix_interf_api", 4, "regexp_matches(lower(class_name), '(interf|api)$')"),
    ("class.suffix_job_batch", 5, "regexp_matches(lower(class_name), '(job|batch)$')"),
    ("method.name_entry_exact", 7, "lower(name) IN ('execute', 'invoke', 'process', 'dispatch')"),
    ("method.prefix_do_send", 4, "regexp_matches(lower(name), '^(do|send)')"),
    ("method.prefix_entry_like", 2, "regexp_matches(lower(name), '^(do|handle|submit|query|list|get|find|send)')"),
    ("fanout.ge_1", 1, "out_degree >= 1"),
    ("fanout.ge_3", 2, "out_degree >= 3"),
    ("fanout.ge_10", 2, "out_degree >= 10"),
    ("penalty.getter_setter_no_fanout", -5, "regexp_matches(lower(name), '^(set|get|is)') AND out_degree = 0"),
]
_SCORED = _LAYERED + _OUT + ", scored AS (SELECT *, CASE WHEN entry_score >= 18 THEN 'high' WHEN entry_score >= 12 THEN 'medium' ELSE 'low' END AS entry_confidence FROM (SELECT o.name, class_name, out_degree, file_path, layer, " + " + ".join(f"CASE WHEN {c} THEN {d} ELSE 0 END" for _, d, c in _RULES) + " AS entry_score FROM outd o LEFT JOIN cg_layered l ON l.name = o.class_name) x)"
_SCORED = _SCORED.replace("SELECT o.name, class_name", "SELECT name, class_name").replace("FROM outd o LEFT JOIN cg_layered l ON l.name = o.class_name", "FROM (SELECT o.*, l.file_path, l.layer FROM outd o LEFT JOIN cg_layered l ON l.name = o.class_name)")
_ENTRY = _SCORED + ", entry AS (SELECT * FROM (SELECT * FROM (SELECT * FROM scored ORDER BY out_degree DESC, name, class_name LIMIT 1000) WHERE entry_score >= 8) ORDER BY entry_score DESC, out_degree DESC, class_name, name LIMIT 200)"


# --- sources -----------------------------------------------------------------
@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents", graph=False)
def scan_hash(spark, sf_dir):
    """S2, C7."""
    return files.hashed(table(spark, sf_dir, "documents"), "text").select("doc_id", "sha256")


@query(f"SELECT page_id, url FROM pages WHERE ends_with(url, '.html') AND len(list_intersect(string_split(url, '/')[:-2], [{_in(fixed.EXCLUDED_DIRS)}])) = 0", graph=False)
def scan_paths(spark, sf_dir):
    """Suffix and excluded directories."""
    return files.kept_paths(table(spark, sf_dir, "pages"), "url", ".html").select("page_id", "url")


def _states(spark, sf_dir):
    """Two states of a file table: per user and event type the last event of the first and of the second half of the time."""
    events = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = events.withColumn("us", micros)
    mid = events.agg(F.floor((F.min("us") + F.max("us")) / 2).alias("mid"))
    rows = events.join(mid).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), "props", "ts", "event_id", (F.col("us") >= F.col("mid")).alias("later"))
    state = lambda later: sinks.last_wins(rows.where(F.col("later") == later).select("path", "props", F.struct("ts", "event_id").alias("o")), ["path"], "o").select("path", F.sha2("props", 256).alias("sha256"))
    return state(True), state(False)


@query("""
WITH m AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS mid FROM events),
e AS (SELECT concat_ws('/', CAST(user_id AS VARCHAR), event_type) AS path, props, ts, event_id, ts >= mid AS later FROM events, m),
s AS (SELECT path, later, sha256(arg_max(props, (ts, event_id))) AS h FROM e GROUP BY path, later)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'new' ELSE 'changed' END AS status
FROM (SELECT * FROM s WHERE later) a FULL JOIN (SELECT * FROM s WHERE NOT later) b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""", graph=False)
def delta_files(spark, sf_dir):
    """New, changed and removed files between two states."""
    return files.delta(*_states(spark, sf_dir))


@query("""
WITH m AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS mid FROM events),
e AS (SELECT concat_ws('/', CAST(user_id AS VARCHAR), event_type) AS path, props, ts, event_id, ts >= mid AS later FROM events, m),
s AS (SELECT path, later, sha256(arg_max(props, (ts, event_id))) AS h FROM e GROUP BY path, later)
SELECT path, arg_max(h, later) AS sha256 FROM s GROUP BY path""", graph=False)
def upsert_state(spark, sf_dir):
    """The second state written over the first."""
    now, before = _states(spark, sf_dir)
    return sinks.upsert(before, now, ["path"])


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, len(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/')) - 1 AS depth FROM pages", graph=False)
def url_parts(spark, sf_dir):
    """Host and directory depth of page addresses."""
    url = F.col("url")
    bare = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), (F.size(F.split(bare, "/")) - 1).cast("long").alias("depth"))


# --- linking -----------------------------------------------------------------
@query("SELECT class_name, name, list_sort(list(param_count)) AS arities FROM cg_method GROUP BY ALL")
def signature_index(g: CodeGraph):
    """A1, D8."""
    return linking.signatures(g.methods)


@query("SELECT type, mode, count(*) AS n FROM cg_link GROUP BY ALL")
def link_modes(g: CodeGraph):
    """J1, J2."""
    return g.links.groupBy("type", "mode").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM cg_raw) AS total_rows, count(*) AS deduplicated_rows, count(*) FILTER (type = 'internal') AS internal_rows, count(*) FILTER (type = 'external') AS external_rows,
count(*) FILTER (callee_class = 'Unknown') AS direct_unknown_rows, count(*) FILTER (mode = 'exact') AS signature_exact_hits, count(*) FILTER (mode = 'fallback') AS unique_fallback_hits, CAST(0 AS BIGINT) AS tolerant_hits,
count(*) FILTER (mode = 'none' AND type = 'external') AS unmatched_to_unknown, count(*) FILTER (mode = 'none' AND type = 'internal') AS internal_unmatched_dropped FROM cg_link""")
def link_statistics(g: CodeGraph):
    """A5."""
    return linking.link_statistics(g.raw_calls, g.links)


@query("""SELECT r.type, CASE WHEN callee_class = 'Unknown' OR l IS NULL THEN 'none' WHEN list_contains(l, arg_count) THEN 'exact' WHEN len(l) = 1 THEN 'fallback'
WHEN list_min(list_transform(l, lambda c: abs(c - arg_count))) <= 1 THEN 'tolerant' ELSE 'none' END AS mode, count(*) AS n
FROM (SELECT DISTINCT * FROM cg_raw) r LEFT JOIN (SELECT class_name, name, list(param_count) AS l FROM cg_method GROUP BY ALL) s ON s.class_name = r.callee_class AND s.name = r.callee GROUP BY ALL""")
def link_modes_tolerant(g: CodeGraph):
    """Arities off by one allowed."""
    return linking.link(g.raw_calls, g.methods, tolerance=1).groupBy("type", "mode").agg(F.count("*").alias("n"))


@query("SELECT * FROM cg_calls")
def calls_table(g: CodeGraph):
    """The edge table."""
    return g.calls


@query("SELECT caller, caller_class, callee, callee_class, type, concat_ws('_to_', caller, callee) AS via_field, max((arg_count, mode))[1] AS arg_count, max((arg_count, mode))[2] AS match_mode FROM cg_link WHERE mode <> 'none' GROUP BY caller, caller_class, callee, callee_class, type")
def edge_details(g: CodeGraph):
    """F19, K9, W8."""
    return linking.edge_details(g.links)


@query("SELECT DISTINCT m.name, m.class_name, c.file_path FROM cg_method m JOIN cg_class c ON c.name = m.class_name")
def belongs_to(g: CodeGraph):
    """J7, K7, K8."""
    return sinks.belongs_to(g.methods, g.classes)


@query("SELECT name, class_name, max(param_count) AS param_count FROM cg_method GROUP BY ALL")
def method_nodes(g: CodeGraph):
    """Methods by (name, class_name), the last row wins."""
    return sinks.last_wins(g.methods.withColumn("o", F.col("param_count")), ["name", "class_name"], "o").select("name", "class_name", "param_count")


@query(f"SELECT DISTINCT callee AS name, CASE WHEN callee IN ({_in(fixed.JDK_METHODS)}) THEN 'jdk_unknown' ELSE 'business_unknown' END AS category FROM cg_unknown")
def external_methods(g: CodeGraph):
    """J6, F8."""
    return linking.unknown_nodes(g.calls)


@query("SELECT k.* FROM cg_known k WHERE caller_class NOT IN (SELECT name FROM cg_class WHERE layer = 'util') AND callee_class NOT IN (SELECT name FROM cg_class WHERE layer = 'util')")
def delete_layer_files(g: CodeGraph):
    """K6: the edges that stay when the files of one layer are removed."""
    left = sinks.delete_files(g.nodes.join(g.classes.select(F.col("name").alias("class_name"), "file_path"), "class_name"), g.classes.where("layer = 'util'").select(F.col("file_path").alias("path")))
    return sinks.delete_edges(g.known, left)


# --- inference ---------------------------------------------------------------
_INFER = f"""
, cand AS (SELECT name AS callee, class_name AS callee_class FROM cg_node), ncand AS (SELECT callee, count(*) AS n FROM cand GROUP BY 1),
p1 AS (SELECT u.*, c.callee_class, 'unique_name' AS reason, 1.0::DOUBLE AS confidence FROM cg_unknown u JOIN ncand n ON n.callee = u.callee AND n.n = 1 JOIN cand c ON c.callee = u.callee),
dirs AS (SELECT name, string_split(file_path, '/')[:-2] AS d FROM cg_class),
u2 AS (SELECT u.* FROM cg_unknown u WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.caller = u.caller AND p1.caller_class = u.caller_class AND p1.callee = u.callee)),
o AS (SELECT a.caller_class, c.callee, c.callee_class, coalesce(list_min(list_filter(list_transform(range(1, least(len(x.d), len(y.d)) + 1), lambda i: CASE WHEN x.d[i] <> y.d[i] THEN i END), lambda i: i IS NOT NULL)) - 1, least(len(x.d), len(y.d))) AS shared
  FROM (SELECT DISTINCT caller_class, callee FROM u2) a JOIN ncand n ON n.callee = a.callee AND n.n > 1 JOIN cand c ON c.callee = a.callee JOIN dirs x ON x.name = a.caller_class JOIN dirs y ON y.name = c.callee_class),
best AS (SELECT * FROM o WHERE shared >= 1 QUALIFY row_number() OVER (PARTITION BY caller_class, callee ORDER BY shared DESC, callee_class) = 1),
p2 AS (SELECT u.caller, u.caller_class, u.callee, b.callee_class, concat('path_proximity:', b.shared) AS reason, round(least(1.0, 0.3 + 0.15 * b.shared), 2)::DOUBLE AS confidence FROM u2 u JOIN best b ON b.caller_class = u.caller_class AND b.callee = u.callee)
"""


@query(_INFER + "SELECT caller, caller_class, callee, callee_class, reason, confidence FROM p1")
def infer_unique(g: CodeGraph):
    """J8."""
    return inference.unique_name(g.unknown, g.methods)


@query(_INFER + "SELECT caller, caller_class, callee, callee_class, reason, confidence FROM p2")
def infer_proximity(g: CodeGraph):
    """J9, J10, W2."""
    return inference.path_proximity(inference.left_unknown(g.unknown, inference.unique_name(g.unknown, g.methods)), g.methods, g.classes)


@query("SELECT u.*, n.class_name AS callee_class, 'mybatis_mapper' AS reason, 0.8::DOUBLE AS confidence FROM cg_unknown u JOIN cg_node n ON n.name = u.callee JOIN cg_class c ON c.name = n.class_name AND c.is_mapper")
def infer_mapper(g: CodeGraph):
    """J11, on all unknown edges."""
    return inference.mapper_proxy(g.unknown, g.methods, g.classes)


@query(_INFER + "SELECT regexp_replace(reason, ':.*', '') AS reason, count(*) AS n FROM (SELECT reason FROM p1 UNION ALL SELECT reason FROM p2) GROUP BY 1")
def inferred_reasons(g: CodeGraph):
    """J8-J11 in turn, A24."""
    return inference.reason_counts(inference.infer(g.unknown, g.methods, g.classes))


@query("SELECT count(*) FILTER (n IS NULL) AS no_candidate, count(*) FILTER (n = 1) AS unique_candidate, count(*) FILTER (n > 1) AS ambiguous FROM cg_unknown u LEFT JOIN (SELECT name, count(*) AS n FROM cg_node GROUP BY 1) c ON c.name = u.callee")
def resolve_potential(g: CodeGraph):
    """J15."""
    return inference.resolve_potential(g.unknown, g.methods)


# --- degrees and structure ---------------------------------------------------
@query("SELECT n.name, n.class_name, count(r.caller) AS n FROM cg_node n LEFT JOIN cg_raw r ON r.caller = n.name AND r.caller_class = n.class_name GROUP BY n.name, n.class_name ORDER BY n DESC, n.class_name, n.name LIMIT 20")
def caller_counts(g: CodeGraph):
    """A2, T1."""
    return degrees.caller_counts(g.nodes, g.raw_calls)


@query("SELECT callee AS name, callee_class AS class_name, count(*) AS in_degree FROM cg_known GROUP BY ALL ORDER BY in_degree DESC, class_name, name LIMIT 20")
def hotspots(g: CodeGraph):
    """A3, A21."""
    return degrees.hot_nodes(g.known)


@query(_OUT[1:] + _IN + "SELECT name, class_name, out_degree, in_degree FROM outd JOIN ind USING (name, class_name)")
def method_degrees(g: CodeGraph):
    """Both degrees of every method."""
    return degrees.out_degrees(g.nodes, g.calls).join(degrees.in_degrees(g.nodes, g.known), ["name", "class_name"])


SQL["method_degrees"] = f"WITH {CG}{_OUT}{_IN}SELECT name, class_name, out_degree, in_degree FROM outd JOIN ind USING (name, class_name)"


@query("SELECT count(*) FILTER (type = 'internal') AS internal, count(*) FILTER (type = 'external') AS external, count(*) FILTER (type = 'unknown') AS unknown, count(*) AS total FROM cg_calls")
def call_statistics(g: CodeGraph):
    """A4, A6."""
    return degrees.call_statistics(g.calls)


@query("SELECT * FROM cg_node n WHERE NOT EXISTS (SELECT 1 FROM cg_calls c WHERE c.caller = n.name AND c.caller_class = n.class_name) AND NOT EXISTS (SELECT 1 FROM cg_known c WHERE c.callee = n.name AND c.callee_class = n.class_name)")
def isolated_methods(g: CodeGraph):
    """J17, A8."""
    return degrees.isolated(g.nodes, g.calls)


@query("SELECT f.a, f.b, f.n AS forward, r.n AS reverse FROM p f JOIN p r ON r.a = f.b AND r.b = f.a WHERE f.a < f.b")
def class_cycles(g: CodeGraph):
    """J13, A10."""
    return degrees.class_cycles(g.known)


SQL["class_cycles"] = f"WITH {CG}, p AS (SELECT caller_class AS a, callee_class AS b, count(*) AS n FROM cg_known WHERE caller_class <> callee_class GROUP BY ALL) SELECT f.a, f.b, f.n AS forward, r.n AS reverse FROM p f JOIN p r ON r.a = f.b AND r.b = f.a WHERE f.a < f.b"


@query("SELECT x.s AS a, x.d AS b FROM cg_edge x JOIN cg_edge y ON y.s = x.d AND y.d = x.s WHERE x.s < x.d")
def method_cycles(g: CodeGraph):
    """J14."""
    return degrees.method_cycles(g.known)


_BAD = f"""SELECT k.caller_class, k.callee_class, count(*) AS n, any_value(x.bucket) AS from_bucket, any_value(y.bucket) AS to_bucket FROM cg_known k JOIN cg_layered x ON x.name = k.caller_class JOIN cg_layered y ON y.name = k.callee_class
WHERE (x.bucket, y.bucket) IN ({', '.join(f"('{a}', '{b}')" for a, b in fixed.FORBIDDEN)}) GROUP BY 1, 2"""


@query(_LAYERED + _BAD)
def layer_violations(g: CodeGraph):
    """A9, F5, J19."""
    return degrees.violations(g.known, g.classes)


@query(_OUT + "SELECT * FROM outd WHERE out_degree > 50")
def god_methods(g: CodeGraph):
    """A11, A20, with a bound that these tables reach."""
    return degrees.god_methods(g.nodes, g.calls, 50)


@query("SELECT class_name, count(*) AS methods FROM cg_node GROUP BY 1 HAVING count(*) > 40 ORDER BY methods DESC, class_name LIMIT 20")
def god_classes(g: CodeGraph):
    """A19, with a bound that these tables reach."""
    return degrees.god_classes(g.nodes, 40)


@query(_IN + "SELECT (SELECT CAST(sum(in_degree) AS BIGINT) FROM (SELECT in_degree FROM ind ORDER BY in_degree DESC, class_name, name LIMIT 20)) AS top_sum, CAST(sum(in_degree) AS BIGINT) AS total, (SELECT sum(in_degree) FROM (SELECT in_degree FROM ind ORDER BY in_degree DESC, class_name, name LIMIT 20)) / sum(in_degree) AS share FROM ind")
def hotspot_share(g: CodeGraph):
    """A12, W7."""
    return degrees.hotspot_share(g.nodes, g.known)


@query(_OUT + "SELECT count(*) FILTER (out_degree = 0) AS d0, count(*) FILTER (out_degree BETWEEN 1 AND 5) AS d1_5, count(*) FILTER (out_degree BETWEEN 6 AND 20) AS d6_20, count(*) FILTER (out_degree BETWEEN 21 AND 50) AS d21_50, count(*) FILTER (out_degree BETWEEN 51 AND 100) AS d51_100, count(*) FILTER (out_degree > 100) AS d100_up FROM outd")
def degree_histogram(g: CodeGraph):
    """A26."""
    return degrees.degree_histogram(g.nodes, g.calls)


_PREFIX = "CASE WHEN starts_with(upper({0}), 'BL') THEN 'BL' WHEN starts_with(upper({0}), 'UI') THEN 'UI' WHEN starts_with(upper({0}), 'DB') THEN 'DB' WHEN starts_with(upper({0}), 'DTO') THEN 'DTO' WHEN starts_with(upper({0}), 'VO') THEN 'VO' WHEN starts_with(upper({0}), 'EN') THEN 'EN' ELSE 'Util/Other' END"


@query("SELECT prefix, count(*) AS classes, CAST(sum(m) AS BIGINT) AS methods FROM (SELECT " + _PREFIX.format("class_name") + " AS prefix, count(*) AS m FROM cg_node GROUP BY class_name) GROUP BY 1")
def prefix_distribution(g: CodeGraph):
    """A28, F10."""
    return degrees.prefix_distribution(g.nodes)


@query("SELECT a, b, count(*) AS n FROM (SELECT " + _PREFIX.format("caller_class") + " AS a, " + _PREFIX.format("callee_class") + " AS b FROM cg_known WHERE caller_class <> callee_class) WHERE a <> b GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 15")
def cross_prefix(g: CodeGraph):
    """A22."""
    return degrees.cross_prefix(g.calls)


@query("SELECT count(*) FILTER (is_mapper) AS mappers, count(*) FILTER (layer IN ('controller', 'service')) AS services FROM cg_class")
def annotation_counts(g: CodeGraph):
    """A25, F1."""
    return degrees.annotation_counts(g.classes)


_DIAGNOSED = """SELECT (SELECT count(*) FROM cg_class) AS classes, (SELECT count(*) FROM cg_node) AS methods, (SELECT count(*) FROM cg_calls) AS calls,
(SELECT count(*) FROM cg_node WHERE class_name NOT IN (SELECT name FROM cg_class)) AS orphan_methods, (SELECT count(*) FROM cg_class WHERE name NOT IN (SELECT class_name FROM cg_node)) AS empty_classes"""


@query(_DIAGNOSED)
def structure_diagnostics(g: CodeGraph):
    """A29, J16."""
    return degrees.diagnostics(g.nodes, g.classes, g.calls)


@query("SELECT (SELECT count(*) FROM cg_class) AS classes, (SELECT count(*) FROM cg_node) AS methods, (SELECT count(*) FROM cg_calls) AS calls, (SELECT count(*) FROM cg_unknown) AS unknown, (SELECT count(*) FROM cg_known) / (SELECT count(*) FROM cg_calls) AS resolve_rate")
def graph_size(g: CodeGraph):
    """A27."""
    return degrees.size_summary(g.nodes, g.classes, g.calls)


@query("SELECT callee AS name, count(*) AS n FROM cg_unknown GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def unknown_names(g: CodeGraph):
    """A23."""
    return degrees.unknown_names(g.calls)


@query("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY caller, caller_class ORDER BY callee_class NULLS FIRST, callee, type) AS INT) AS rank FROM cg_calls) WHERE rank <= 5")
def fan_out(g: CodeGraph):
    """G3, G4, T5, with a cap that these tables reach."""
    return degrees.fan_out(g.calls, 5)


# --- taxonomy, layers, domains -----------------------------------------------
_JDK_LOWER = _in(n for n in fixed.JDK_METHODS)
_CATEGORY = f""", cat AS (SELECT *, CASE WHEN callee IN ({_JDK_LOWER}) OR lower(callee) IN ({_JDK_LOWER}) THEN 'jdk_core' WHEN regexp_matches(lower(callee), '{'|'.join(fixed.INFRA_MARKERS)}') THEN 'infra_framework'
WHEN regexp_matches(lower(callee), '{'|'.join(fixed.THIRD_PARTY_MARKERS)}') THEN 'third_party_lib' WHEN regexp_matches(lower(callee), '{'|'.join(fixed.SHARED_MARKERS)}') OR regexp_matches(lower(caller_class), 'common|shared|base') THEN 'internal_shared_lib_missing' ELSE 'true_unresolved' END AS category FROM cg_unknown)"""


@query(_CATEGORY + "SELECT " + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in fixed.UNKNOWN_CATEGORIES) + ", count(*) AS total, count(*) FILTER (category <> 'jdk_core') AS business FROM cat")
def unknown_breakdown(g: CodeGraph):
    """A13, F8, F9."""
    return taxonomy.breakdown(g.unknown)


@query(_CATEGORY + ", t AS (SELECT caller_class, category, count(*) AS n FROM cat GROUP BY ALL) SELECT caller_class, CAST(sum(n) AS BIGINT) AS unknown, sum(n) / (SELECT count(*) FROM cat) AS share, arg_max(category, (n, -list_position([" + _in(fixed.UNKNOWN_CATEGORIES) + "], category))) AS dominant FROM t GROUP BY 1 ORDER BY unknown DESC, caller_class LIMIT 15")
def unknown_top_callers(g: CodeGraph):
    """A14."""
    return taxonomy.top_callers(g.unknown)


@query("SELECT count(*) FILTER (regexp_matches(lower(caller_class), 'util|helper|common')) AS util, count(*) AS total FROM cg_unknown")
def util_unknown(g: CodeGraph):
    """F7."""
    return taxonomy.util_unknown(g.unknown)


@query(_LAYERED + "SELECT name, file_path, layer, domain, bucket, priority FROM cg_layered")
def class_layers(g: CodeGraph):
    """F2-F6, F11, F20, H8, H9, T6."""
    return taxonomy.layered(g.classes)


@query(_LAYERED + "SELECT layer, priority, count(*) AS class_count, array_to_string(list_sort(list(name)), ',') AS class_names FROM cg_layered GROUP BY 1, 2")
def layer_statistics(g: CodeGraph):
    """A7."""
    return taxonomy.layer_statistics(g.classes)


@query(_LAYERED + "SELECT count(*) FILTER (layer = 'other') AS other_count, count(*) AS classes, count(*) FILTER (layer = 'other') / count(*) AS other_ratio FROM cg_layered")
def layer_diagnostics(g: CodeGraph):
    """A30."""
    return taxonomy.other_ratio(g.classes)


@query(_ENTRY + """SELECT domain, count(*) AS classes, CAST(sum(m) AS BIGINT) AS methods, CAST(sum(u) AS BIGINT) AS unknown_calls, CAST(sum(e) AS BIGINT) AS entries FROM (SELECT l.domain, (SELECT count(*) FROM cg_node n WHERE n.class_name = l.name) AS m, (SELECT count(*) FROM cg_unknown n WHERE n.caller_class = l.name) AS u, (SELECT count(*) FROM entry n WHERE n.class_name = l.name) AS e FROM cg_layered l) GROUP BY 1""")
def domain_rollup(g: CodeGraph):
    """A16, J19."""
    return taxonomy.domain_rollup(g.classes, g.nodes, g.unknown, entries.entries(g.nodes, g.classes, g.calls))


# --- entries -----------------------------------------------------------------
@query(_SCORED + "SELECT name, class_name, out_degree, entry_score, entry_confidence FROM scored")
def entry_scores(g: CodeGraph):
    """E1, E3."""
    return entries.scored(g.nodes, g.classes, g.calls).select("name", "class_name", "out_degree", "entry_score", "entry_confidence")


@query(_ENTRY + "SELECT name, class_name, out_degree, entry_score FROM entry")
def entry_methods(g: CodeGraph):
    """T4."""
    return entries.entries(g.nodes, g.classes, g.calls).select("name", "class_name", "out_degree", "entry_score")


@query(_ENTRY + ", hit AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule FROM entry WHERE {c}" for r, _, c in _RULES) + ") SELECT rule, count(*) AS hits FROM hit GROUP BY 1 ORDER BY hits DESC, rule LIMIT 10")
def entry_rules(g: CodeGraph):
    """E2, A15."""
    return entries.rule_hits(entries.entries(g.nodes, g.classes, g.calls))


@query(_ENTRY + "SELECT count(*) AS entries, count(*) FILTER (entry_confidence = 'high') AS high, count(*) FILTER (entry_confidence = 'medium') AS medium, count(*) FILTER (entry_confidence = 'low') AS low, coalesce(count(*) FILTER (entry_confidence = 'high') / nullif(count(*), 0), 0) AS high_share FROM entry")
def entry_confidence(g: CodeGraph):
    """A15, E3."""
    return entries.confidence_counts(entries.entries(g.nodes, g.classes, g.calls))


@query(_ENTRY + "SELECT name, class_name FROM entry e WHERE NOT EXISTS (SELECT 1 FROM cg_known k WHERE k.caller = e.name AND k.caller_class = e.class_name)")
def entries_without_downstream(g: CodeGraph):
    """A31."""
    return entries.without_downstream(entries.entries(g.nodes, g.classes, g.calls), g.known)


# --- traversal ---------------------------------------------------------------
def _first(g: CodeGraph) -> DataFrame:
    """The least method key of each class in the layer controller."""
    key = naming.method_key(F.col("class_name"), F.col("name"))
    ctl = g.classes.where("layer = 'controller'").select(F.col("name").alias("class_name"))
    return g.nodes.join(ctl, "class_name").groupBy("class_name").agg(F.min(key).alias("node")).select(F.col("node").alias("origin"), "node")


_FIRST = ", src AS (SELECT min(concat_ws('.', class_name, name)) AS origin FROM cg_node WHERE class_name IN (SELECT name FROM cg_class WHERE layer = 'controller') GROUP BY class_name)"
_KEYED = ", ke AS (SELECT DISTINCT concat_ws('.', caller_class, caller) AS s, concat_ws('.', callee_class, callee) AS d, type FROM cg_known)"


def _levels(depth: int, up: bool) -> str:
    a, b = ("d", "s") if up else ("s", "d")
    out = _FIRST + _KEYED + f", l1 AS (SELECT origin, {b} AS node, 1 AS depth, min((origin, type)) AS e FROM src JOIN ke ON {a} = origin GROUP BY 1, 2), r1 AS (SELECT * FROM l1)"
    for i in range(2, depth + 1):
        out += f", l{i} AS (SELECT origin, {b} AS node, {i} AS depth, min((node, type)) AS e FROM l{i - 1} JOIN ke ON {a} = node WHERE NOT EXISTS (SELECT 1 FROM r{i - 1} r WHERE r.origin = l{i - 1}.origin AND r.node = {b}) GROUP BY origin, {b}), r{i} AS (SELECT * FROM r{i - 1} UNION ALL SELECT * FROM l{i})"
    return out + f" SELECT origin, node, depth, e[2] AS type, e[1] AS via FROM r{depth}"


@query(_levels(3, False))
def downstream(g: CodeGraph):
    """What the first method of each controller reaches within three calls."""
    return traverse.reach(traverse.keyed(g.known), _first(g), 3)


@query(_levels(3, True))
def upstream(g: CodeGraph):
    """What reaches the first method of each controller."""
    return traverse.reach(traverse.keyed(g.known), _first(g), 3, up=True)


def _all(g: CodeGraph) -> DataFrame:
    """Every method key of the classes in the layer controller."""
    key = naming.method_key(F.col("class_name"), F.col("name"))
    ctl = g.classes.where("layer = 'controller'").select(F.col("name").alias("class_name"))
    return g.nodes.join(ctl, "class_name").select(key.alias("origin"), key.alias("node")).distinct()


_EVERY = ", src AS (SELECT DISTINCT concat_ws('.', class_name, name) AS origin FROM cg_node WHERE class_name IN (SELECT name FROM cg_class WHERE layer = 'controller'))"


def _whole(sql: str) -> str:
    """A twin for every method of each controller, each of its steps derived once."""
    return sql.replace(_FIRST[2:], _EVERY[2:]).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query(_whole(_levels(fixed.DEPTH, False)))
def downstream_every(g: CodeGraph):
    """What every method of each controller reaches, to the default depth."""
    return traverse.reach(traverse.keyed(g.known), _all(g))


@query(_whole(_levels(fixed.DEPTH, True)))
def upstream_every(g: CodeGraph):
    """What reaches every method of each controller, to the default depth."""
    return traverse.reach(traverse.keyed(g.known), _all(g), up=True)


@query(_ENTRY + ", RECURSIVE_MARK AS (SELECT 1) SELECT 1")
def reachable_methods(g: CodeGraph):
    """What any entry reaches."""
    found = entries.entries(g.nodes, g.classes, g.calls)
    return traverse.reachable(traverse.keyed(g.known), found.select(naming.method_key(F.col("class_name"), F.col("name")).alias("node")))


_R = _ENTRY + ", x0 AS (SELECT concat_ws('.', class_name, name) AS node FROM entry)"
for _i in range(1, fixed.DEPTH + 1):
    _R += f", x{_i} AS (SELECT node FROM x{_i - 1} UNION SELECT d FROM cg_edge JOIN x{_i - 1} ON s = node)"
SQL["reachable_methods"] = f"WITH {CG}{_R} SELECT node FROM x{fixed.DEPTH}"


def _goal(g: CodeGraph) -> str:
    key = naming.method_key(F.col("class_name"), F.col("name"))
    return g.nodes.agg(F.max(key)).first()[0] or ""


def _paths(depth: int) -> str:
    out = _FIRST + ", goal AS (SELECT max(concat_ws('.', class_name, name)) AS g FROM cg_node), q0 AS (SELECT origin, origin AS node, [origin] AS path FROM src), v0 AS (SELECT origin, node FROM q0)"
    for i in range(1, depth + 1):
        out += f", q{i} AS (SELECT origin, d AS node, min(list_append(path, d)) AS path FROM q{i - 1} JOIN cg_edge ON s = node WHERE node <> (SELECT g FROM goal) AND NOT EXISTS (SELECT 1 FROM v{i - 1} v WHERE v.origin = q{i - 1}.origin AND v.node = d) GROUP BY origin, d), v{i} AS (SELECT * FROM v{i - 1} UNION SELECT origin, node FROM q{i})"
    return out + " SELECT origin, array_to_string(min_by(path, len(path)), ' > ') AS path FROM (" + " UNION ALL ".join(f"SELECT origin, path FROM q{i} WHERE node = (SELECT g FROM goal)" for i in range(depth + 1)) + ") GROUP BY origin"


@query(_paths(4))
def data_flow_path(g: CodeGraph):
    """A shortest path from the first method of each controller to the last method of all."""
    return traverse.shortest_path(traverse.keyed(g.known), _first(g), _goal(g), 4).select("origin", F.array_join("path", " > ").alias("path"))


@query(_whole(_paths(fixed.DEPTH)))
def data_flow_path_every(g: CodeGraph):
    """A shortest path from every method of each controller to the last method of all, to the default depth."""
    return traverse.shortest_path(traverse.keyed(g.known), _all(g), _goal(g)).select("origin", F.array_join("path", " > ").alias("path"))


_T = _FIRST + ", step AS (SELECT * FROM (SELECT s, d, min(type) AS type, row_number() OVER (PARTITION BY s ORDER BY d, min(type)) AS r FROM (SELECT concat_ws('.', caller_class, caller) AS s, concat_ws('.', callee_class, callee) AS d, type FROM cg_known) GROUP BY s, d) WHERE r <= 8), t0 AS (SELECT origin AS root, [origin] AS path, origin AS node, 0 AS depth, NULL::VARCHAR AS type, NULL::VARCHAR AS truncated FROM src)"
for _i in range(1, 4):
    _T += f", t{_i} AS (SELECT root, list_append(path, d) AS path, d AS node, {_i} AS depth, step.type, CASE WHEN list_contains(path, d) THEN 'cycle' WHEN {_i} = 3 THEN 'max_depth' END AS truncated FROM t{_i - 1} JOIN step ON s = node WHERE truncated IS NULL)"
_T += ", tree AS (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(4)) + ")"


@query(_T + " SELECT root, array_to_string(path, ' > ') AS path, node, depth, type, truncated FROM tree")
def call_tree(g: CodeGraph):
    """Call trees of depth three with at most eight children a node."""
    return traverse.call_tree(traverse.keyed(g.known), _first(g).select(F.col("node").alias("root")), 3, 8).select("root", F.array_join("path", " > ").alias("path"), "node", "depth", "type", "truncated")


@query(_T + " SELECT root, array_to_string(path, ' > ') AS path, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS place FROM tree) WHERE place <= 100")
def call_tree_budget(g: CodeGraph):
    """The first hundred nodes in pre-order."""
    tree = traverse.call_tree(traverse.keyed(g.known), _first(g).select(F.col("node").alias("root")), 3, 8)
    return traverse.budgeted(tree, 100).select("root", F.array_join("path", " > ").alias("path"), "place")


@query(_T + " SELECT root, 'graph TD\n' || string_agg('  ' || a || CASE WHEN type = 'internal' THEN ' --> ' ELSE ' -.-> ' END || b, chr(10) ORDER BY a, b, type) AS text FROM (SELECT DISTINCT root, regexp_replace(path[-2], '[^A-Za-z0-9_]', '_', 'g') AS a, regexp_replace(node, '[^A-Za-z0-9_]', '_', 'g') AS b, type FROM tree WHERE depth > 0) GROUP BY root")
def mermaid_call_chain(g: CodeGraph):
    """K15, H5."""
    return trees.mermaid_calls(traverse.call_tree(traverse.keyed(g.known), _first(g).select(F.col("node").alias("root")), 3, 8))


def _first_of_trees(g: CodeGraph) -> DataFrame:
    return traverse.first_of_tree(traverse.keyed(g.known), _all(g).select(F.col("node").alias("root")))


@query()
def call_tree_every(g: CodeGraph):
    """The call tree of every method of each controller, with the default depth, fan-out and number of nodes."""
    return _first_of_trees(g).select("root", F.array_join("path", " > ").alias("path"), "node", "depth", "type", "truncated", "place")


@query()
def mermaid_call_chain_every(g: CodeGraph):
    """The trees of call_tree_every as diagrams."""
    return trees.mermaid_calls(_first_of_trees(g))


@query(_EVERY + " SELECT origin AS node, (SELECT count(*) FROM cg_edge WHERE s = origin) AS downstream, (SELECT count(*) FROM cg_edge WHERE d = origin) AS upstream FROM src")
def focus_neighbours(g: CodeGraph):
    """G12, G13."""
    return traverse.neighbours(traverse.keyed(g.known), _all(g).select("node"))


# --- chains ------------------------------------------------------------------
def _order_chains(spark, sf_dir) -> DataFrame:
    return _chains_of(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"))


def _chains_of(part, lines) -> DataFrame:
    """Every order with two lines or more as a chain of the methods it names, in line order."""
    hop = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.struct(F.col("p_brand").alias("class"), F.translate("p_name", " ", "_").alias("method")).alias("hop"))
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy(F.col("l_orderkey").cast("string").alias("name")).agg(F.sort_array(F.collect_list(hop)).alias("h"))
    return rows.select("name", F.transform("h", lambda x: x["hop"]).alias("hops")).where(F.size("hops") >= 2)


_CHAIN = """, hop AS (SELECT CAST(l_orderkey AS VARCHAR) AS name, row_number() OVER w - 1 AS pos, p_brand AS ac, replace(p_name, ' ', '_') AS am, lead(p_brand) OVER w AS bc, lead(replace(p_name, ' ', '_')) OVER w AS bm
FROM lineitem JOIN part ON l_partkey = p_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_brand, p_name)),
judged AS (SELECT h.*, k.caller IS NOT NULL AS hit FROM hop h LEFT JOIN (SELECT DISTINCT caller, caller_class, callee, callee_class FROM cg_known) k ON k.caller = am AND k.caller_class = ac AND k.callee = bm AND k.callee_class = bc WHERE bc IS NOT NULL)"""


@query("", graph=False)
def chain_evaluation(spark, sf_dir):
    """Orders as critical chains."""
    g = from_tables(spark, sf_dir)
    return chains.evaluate(_order_chains(spark, sf_dir), g.known, g.nodes)


SQL["chain_evaluation"] = f"WITH {CG}{_CHAIN} SELECT name, count(*) AS total_hops, count(*) FILTER (hit) AS matched_hops, bool_and(hit) AS full_hit, CAST(min(pos) FILTER (NOT hit) AS INT) AS first_break, CASE WHEN NOT bool_and(hit) THEN 'missing_call' END AS reason FROM judged GROUP BY name"


_BONUS = "CASE " + " ".join(f"WHEN regexp_matches(lower(callee_class), '{'|'.join(m)}') THEN {b}" for m, b in fixed.ROLE_BONUS) + " ELSE 0 END"
_S = _ENTRY + f", st AS (SELECT *, own + {_BONUS} AS score FROM (SELECT caller_class, caller, callee_class, callee, max(CASE WHEN type = 'internal' THEN 3 ELSE 2 END) AS own FROM cg_known GROUP BY ALL)), w0 AS (SELECT concat_ws('_', 'auto', class_name, name) AS name, entry_score, [class_name || '.' || name] AS hops, class_name AS c, name AS m, 0 AS ts FROM entry)"
for _i in range(1, 5):
    _S += f", w{_i} AS (SELECT w.name, entry_score, list_append(hops, callee_class || '.' || callee) AS hops, callee_class AS c, callee AS m, ts + own AS ts FROM w{_i - 1} w JOIN st ON caller_class = c AND caller = m WHERE NOT list_contains(hops, callee_class || '.' || callee) QUALIFY row_number() OVER (PARTITION BY w.name ORDER BY score DESC, callee_class, callee) = 1)"
_S += ", longest AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(1, 5)) + ") QUALIFY row_number() OVER (PARTITION BY name ORDER BY len(hops) DESC) = 1), once AS (SELECT hops, max((entry_score, ts, name)) AS r FROM longest GROUP BY hops), flat AS (SELECT r[3] AS name, hops, r[1] AS entry_score, r[2] AS type_score FROM once)"
_S += ", few AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY hops[2:4] ORDER BY len(hops) DESC, type_score DESC, entry_score DESC, name) <= 2) SELECT name, array_to_string(hops, ' > ') AS hops, entry_score, type_score FROM few ORDER BY len(hops) DESC, type_score DESC, entry_score DESC, name LIMIT 10"


@query(_S)
def suggested_chains(g: CodeGraph):
    """G9, G10, W5, W6."""
    found = entries.entries(g.nodes, g.classes, g.calls)
    return chains.suggest(found, g.known).select("name", F.array_join(F.transform("hops", lambda h: F.concat_ws(".", h["class"], h["method"])), " > ").alias("hops"), "entry_score", "type_score")


# --- quality -----------------------------------------------------------------
def _report(spark, sf_dir) -> DataFrame:
    g = from_tables(spark, sf_dir)
    return quality.metrics(g.classes, g.nodes, g.calls, _order_chains(spark, sf_dir))


_METRICS = f"""{_R.replace('WITH', '')}{_CATEGORY}{_IN}{_CHAIN}, bad AS ({_BAD}), per AS (SELECT name, bool_and(hit) AS full, count(*) AS hops, count(*) FILTER (hit) AS ok FROM judged GROUP BY name),
crit AS (SELECT DISTINCT ac || '.' || am AS node FROM hop h WHERE name IN (SELECT name FROM judged)),
cyc AS (SELECT DISTINCT a.caller_class, a.callee_class FROM cg_known a JOIN cg_known b ON a.caller_class = b.callee_class AND a.callee_class = b.caller_class WHERE a.caller_class < a.callee_class),
iso AS (SELECT * FROM cg_node n WHERE NOT EXISTS (SELECT 1 FROM cg_calls c WHERE c.caller = n.name AND c.caller_class = n.class_name) AND NOT EXISTS (SELECT 1 FROM cg_known c WHERE c.callee = n.name AND c.callee_class = n.class_name)),
c AS (SELECT (SELECT count(*) FROM cg_calls) AS calls, (SELECT count(*) FROM cg_node) AS methods, (SELECT count(*) FROM cg_unknown) AS unk, (SELECT count(*) FROM x10) AS reached, (SELECT count(*) FROM crit) AS crit, (SELECT count(*) FROM per) AS chains)
SELECT metric, round(coalesce(value, 0)::DOUBLE, 6) AS value FROM (
SELECT 'broken_chain_rate' AS metric, unk / calls AS value FROM c UNION ALL
SELECT 'business_broken_chain_rate', (SELECT count(*) FROM cat WHERE category <> 'jdk_core') / calls FROM c UNION ALL
SELECT 'reachability_rate', reached / methods FROM c UNION ALL
SELECT 'key_chain_hit_rate', (SELECT count(*) FROM per WHERE "full") / chains FROM c UNION ALL
SELECT 'critical_chain_retention', (SELECT sum(ok) / sum(hops) FROM per) UNION ALL
SELECT 'critical_hop_dropout', 1 - (SELECT sum(ok) / sum(hops) FROM per) UNION ALL
SELECT 'util_unknown_ratio', (SELECT count(*) FROM cg_unknown WHERE regexp_matches(lower(caller_class), 'util|helper|common')) / unk FROM c UNION ALL
SELECT 'critical_chain_coverage', (SELECT count(*) FROM crit WHERE node IN (SELECT node FROM x10)) / crit FROM c UNION ALL
SELECT 'critical_chain_reach_share', crit / reached FROM c UNION ALL
SELECT 'critical_definition_presence', (SELECT count(*) FROM crit WHERE node IN (SELECT class_name || '.' || name FROM cg_node)) / crit FROM c UNION ALL
SELECT 'entry_confidence_proxy', (SELECT count(*) FILTER (entry_confidence = 'high') / count(*) FROM entry) UNION ALL
SELECT 'layer_violation_rate', (SELECT coalesce(sum(n), 0) FROM bad) / (SELECT count(*) FROM cg_known) UNION ALL
SELECT 'cycle_count', (SELECT count(*) FROM cyc) UNION ALL
SELECT 'god_method_ratio', (SELECT count(*) FROM outd WHERE out_degree > 100) / methods FROM c UNION ALL
SELECT 'isolated_method_ratio', (SELECT count(*) FROM iso) / methods FROM c UNION ALL
SELECT 'hotspot_fragility_top20_share', (SELECT sum(in_degree) FROM (SELECT in_degree FROM ind ORDER BY in_degree DESC, class_name, name LIMIT 20)) / (SELECT sum(in_degree) FROM ind))"""


@query("", graph=False)
def quality_metrics(spark, sf_dir):
    """A17, A18, Q1."""
    return _report(spark, sf_dir)


SQL["quality_metrics"] = f"WITH {CG}{_METRICS}"


@query("", graph=False)
def threshold_gate(spark, sf_dir):
    """A33."""
    return quality.gate(_report(spark, sf_dir))


_GATE = ", ".join(f"('{m}', '{o}', {b}::DOUBLE, {str(x).lower()})" for m, o, b, x in fixed.GATE)
SQL["threshold_gate"] = f"WITH r AS (WITH {CG}{_METRICS}) SELECT g.metric, op, bound, mandatory, v.value, coalesce(CASE WHEN op = '<=' THEN value <= bound ELSE value >= bound END, false) AS passed FROM (VALUES {_GATE}) g(metric, op, bound, mandatory) LEFT JOIN (SELECT * FROM r UNION ALL SELECT 'key_chain_hop_hit_rate', value FROM r WHERE metric = 'critical_chain_retention') v ON v.metric = g.metric"


# --- trees and documents -----------------------------------------------------
_LT = _LAYERED + ", lt AS (SELECT layer, priority, l.name AS class_name, array_to_string(list_sort(list(n.name)), ',') AS methods, count(n.name) AS n_methods FROM cg_layered l LEFT JOIN cg_node n ON n.class_name = l.name WHERE layer <> 'other' GROUP BY layer, priority, l.name)"


@query(_LT + " SELECT layer, priority, class_name, methods, n_methods FROM lt")
def layer_tree(g: CodeGraph):
    """H1, A35, F20, T6."""
    return trees.layer_tree(g.classes, g.nodes)


@query(", pk AS (SELECT ['com', 'acme', 'd' || (b % 5)] AS d, layer, 'B' || b AS leaf FROM cg_class), pp AS (SELECT CASE WHEN layer = 'misc' THEN list_concat(d, ['misc', leaf]) ELSE [layer, leaf] END AS p FROM pk), pre AS (SELECT p[1:i] AS q, i = len(p) AS leaf FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM pp)) SELECT array_to_string(q, '/') AS path, array_to_string(q[1 : len(q) - 1], '/') AS parent, q[-1] AS name, CASE WHEN bool_or(NOT leaf) THEN 'package' ELSE 'class' END AS kind, count(*) AS classes FROM pre GROUP BY q")
def package_tree(g: CodeGraph):
    """H2, H3, T7."""
    return trees.package_tree(g.classes)


@query(_LAYERED + ", l AS (SELECT layer, priority, list_sort(list(name)) AS n FROM cg_layered WHERE layer <> 'other' GROUP BY 1, 2), b AS (SELECT priority, layer, '  subgraph ' || layer || chr(10) || array_to_string(list_transform(n, lambda x: '    ' || regexp_replace(x, '[^A-Za-z0-9_]', '_', 'g') || '[\"' || x || '\"]'), chr(10)) || chr(10) || '  end' AS body, '  ' || regexp_replace(n[1], '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(lead(n[1]) OVER (ORDER BY priority, layer), '[^A-Za-z0-9_]', '_', 'g') AS edge FROM l) SELECT 'graph TD' || chr(10) || string_agg(body, chr(10) ORDER BY priority, layer) || chr(10) || string_agg(edge, chr(10) ORDER BY priority, layer) AS text FROM b")
def mermaid_layer_tree(g: CodeGraph):
    """K15, H4, C13."""
    return trees.mermaid_layers(g.classes)


_NM = "regexp_replace({0}, '[^A-Za-z0-9_]', '_', 'g')"


@query(_LAYERED + ", pl AS (SELECT name, layer, dense_rank() OVER (ORDER BY priority, layer) AS n FROM cg_layered WHERE layer <> 'other'), line AS (SELECT 0 AS k, n AS x, '' AS y, 'package \"' || layer || '\" {' || chr(10) || string_agg('  class ' || " + _NM.format("name") + ", chr(10) ORDER BY name) || chr(10) || '}' AS line FROM pl GROUP BY n, layer UNION ALL SELECT 1, a.n, " + _NM.format("a.name") + " || ' --> ' || " + _NM.format("b.name") + ", " + _NM.format("a.name") + " || ' --> ' || " + _NM.format("b.name") + " FROM pl a JOIN pl b ON b.n = a.n + 1) SELECT '@startuml' || chr(10) || string_agg(line, chr(10) ORDER BY k, x, y, line) || chr(10) || '@enduml' AS text FROM line")
def plantuml_layer_tree(g: CodeGraph):
    """K16, H6."""
    return trees.plantuml_layers(g.classes)


_LD = _LAYERED + ", m AS (SELECT class_name, list_sort(list(name)) AS m FROM cg_node GROUP BY 1), ld AS (SELECT layer, priority, '## ' || layer || ' (' || count(*) || ')' || chr(10) || string_agg('- ' || name || ': ' || coalesce(array_to_string(m[1:8], ', '), '') || CASE WHEN len(m) > 8 THEN ' (+' || (len(m) - 8) || ')' ELSE '' END, chr(10) ORDER BY name) AS text FROM cg_layered LEFT JOIN m ON class_name = name GROUP BY 1, 2)"


@query(_LD + " SELECT layer, priority, text FROM ld")
def layer_docs(g: CodeGraph):
    """K17, H10."""
    return trees.layer_docs(g.classes, g.nodes)


@query(_LD + " SELECT '# Architecture' || chr(10) || string_agg(text, chr(10) ORDER BY priority, layer) AS text FROM ld")
def architecture_doc(g: CodeGraph):
    """H11, K17."""
    return trees.architecture_doc(g.classes, g.nodes)


@query("SELECT name FROM cg_class WHERE contains(lower(name), '#1') OR name IN (SELECT class_name FROM cg_node WHERE contains(lower(name), '#1')) UNION SELECT class_name FROM cg_node WHERE contains(lower(name), 'small')")
def search_classes(g: CodeGraph):
    """F13, A34."""
    return trees.search_classes(g.classes, g.nodes, "#1").union(trees.search_classes(g.classes, g.nodes, "small")).distinct()


# --- vectors -----------------------------------------------------------------
def _vector_queries(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")).select(F.col("label").alias("query_id"), "q", "label")


_D = "list_sum(list_transform(range(1, 65), lambda i: (v.embedding[i]::DOUBLE - q.q[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.q[i]::DOUBLE)))"
_VQ = "WITH q AS (SELECT label AS query_id, label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label), s AS (SELECT query_id, v.vec_id, " + _D + " AS d FROM embeddings v JOIN q ON {on}) SELECT query_id, vec_id, round(d, 4) AS d, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5"


@query(_VQ.replace("{on}", "true"), graph=False)
def vector_topk(spark, sf_dir):
    """V1, V6: the five nearest vectors of the first vector of each label."""
    v, q = _vector_queries(spark, sf_dir)
    return vectors.top_k(v, q, 5).select("query_id", "vec_id", F.round("d", 4).alias("d"), "rank")


@query(_VQ.replace("{on}", "v.label = q.label"), graph=False)
def vector_topk_filtered(spark, sf_dir):
    """Among vectors of the same label only."""
    v, q = _vector_queries(spark, sf_dir)
    return vectors.top_k(v, q, 5, same="label").select("query_id", "vec_id", F.round("d", 4).alias("d"), "rank")


def _every_query(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")


_VE = "WITH q AS (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), " + _VQ.split("), ", 1)[1]


@query(_VE.replace("{on}", "true"), graph=False)
def vector_topk_every(spark, sf_dir):
    """V1, V6: the five nearest vectors of every vector whose id is divisible by 20, among all."""
    v, q = _every_query(spark, sf_dir)
    return vectors.top_k(v, q, 5).select("query_id", "vec_id", F.round("d", 4).alias("d"), "rank")


@query(_VE.replace("{on}", "v.label = q.label"), graph=False)
def vector_topk_filtered_every(spark, sf_dir):
    """The same queries among vectors of the same label only."""
    v, q = _every_query(spark, sf_dir)
    return vectors.top_k(v, q, 5, same="label").select("query_id", "vec_id", F.round("d", 4).alias("d"), "rank")


@query(_LAYERED + _OUT + _IN + " SELECT concat_ws('::', l.file_path, o.class_name, o.name) AS id, 'Method ' || o.name || ' of ' || o.class_name AS summary, l.file_path, o.name AS method_name, o.class_name, l.layer, out_degree AS call_count, in_degree AS callers_count FROM outd o JOIN ind i ON i.name = o.name AND i.class_name = o.class_name JOIN cg_layered l ON l.name = o.class_name")
def chunks(g: CodeGraph):
    """V5, D11, F17."""
    return vectors.chunks(g.nodes, g.classes, g.calls)


_CONTEXT = f", dn AS (WITH {_levels(2, False)[2:]}), up AS (WITH {_levels(2, True)[2:]}), near AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, node) AS r FROM (SELECT origin, depth, node FROM dn UNION SELECT origin, depth, node FROM up)){_FIRST} SELECT src.origin AS query_id, '# ' || src.origin || coalesce(chr(10) || string_agg('  ' || depth || ' ' || node, chr(10) ORDER BY r), '') AS context, src.origin AS refs FROM src LEFT JOIN near ON near.origin = src.origin AND r <= 30 GROUP BY src.origin"


@query(_CONTEXT)
def rag_context(g: CodeGraph):
    """Question context of the first method of each controller, two hops both ways."""
    return _rag_context(g, _first(g))


@query(_whole(_CONTEXT))
def rag_context_every(g: CodeGraph):
    """Question context of every method of each controller."""
    return _rag_context(g, _all(g))


def _rag_context(g: CodeGraph, asked: DataFrame) -> DataFrame:
    return rag.around_hits(g, asked.select(F.col("origin").alias("query_id"), F.lit(1).alias("rank"), "node"))


@query("SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, -r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations) WHERE r <= 4 GROUP BY conv_id", graph=False)
def chat_context(spark, sf_dir):
    """D16."""
    return vectors.chat_context(table(spark, sf_dir, "conversations"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", graph=False)
def labelled_documents(spark, sf_dir):
    """Left join with a default."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", graph=False)
def unlabelled_documents(spark, sf_dir):
    """Anti join."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


# --- extraction and incremental runs -----------------------------------------
def _parsed(g: CodeGraph) -> dict[str, DataFrame]:
    from .operators.extract import parse
    from .plans.sources_of_graph import write
    from .sources.tables import save

    return parse(save(write(g), "sources"))


_J = "regexp_replace({0}, '[^A-Za-z0-9_]', '', 'g')"

_WRITTEN = (
    ", wl AS (SELECT DISTINCT caller_class AS k, caller AS m, '    ' || CASE WHEN type = 'internal' THEN '' WHEN callee_class = 'Unknown' THEN 'ghost.' ELSE 'f' || " + _J.format("callee_class") + " || '.' END || callee || '(' || array_to_string(range(1, arg_count + 1), ', ') || ')' AS c, * FROM (SELECT DISTINCT * FROM cg_raw))"
    ", wt AS (SELECT *, c || '; // a call(1, 2)' || chr(10) AS line FROM wl)"
    ", wb AS (SELECT k, m, string_agg(line, '' ORDER BY line) AS body FROM wt GROUP BY k, m)"
    ", wf AS (SELECT class_name AS k, name AS m, min(param_count) AS p FROM cg_method GROUP BY ALL)"
    ", wm AS (SELECT class_name AS k, name AS m, param_count AS p, coalesce(CASE WHEN param_count = wf.p THEN body END, '') AS body, '  /* void no(); */' || chr(10) || '  ' AS lead,"
    " 'public void ' || name || '(' || array_to_string(list_transform(range(1, param_count + 1), lambda i: 'int a' || i), ', ') || ') {' || chr(10) AS front FROM cg_method JOIN wf ON wf.k = class_name AND wf.m = name LEFT JOIN wb ON wb.k = class_name AND wb.m = name)"
    ", wd AS (SELECT caller_class AS k, string_agg('  @Autowired' || chr(10) || '  private ' || d || ' f' || d || ';' || chr(10), '' ORDER BY d) AS fields FROM (SELECT DISTINCT caller_class, " + _J.format("callee_class") + " AS d FROM cg_raw WHERE type = 'external' AND callee_class <> 'Unknown') GROUP BY caller_class)"
    ", wh AS (SELECT name AS k, file_path, '// ä€𝄞 \"' || chr(10) || 'package com.acme;' || chr(10) || 'import java.util.List;' || chr(10) || CASE WHEN is_mapper THEN '@Mapper' ELSE '@Service' END || chr(10) || 'public class ' || " + _J.format("name") + " || ' {' || chr(10) || coalesce(fields, '') AS head FROM cg_class LEFT JOIN wd ON wd.k = name)"
    ", wa AS (SELECT *, front || body || '  }' AS code FROM wm)"
    ", wp AS (SELECT *, sum(length(lead) + length(code) + 1) OVER (PARTITION BY k ORDER BY lead || code || chr(10) ROWS UNBOUNDED PRECEDING) - length(code) - 1 AS before FROM wa)"
    ", ws AS (SELECT wp.*, file_path, CAST(length(head) + before AS INT) AS first FROM wp JOIN wh USING (k))"
)


@query(_WRITTEN + " SELECT DISTINCT m AS name, " + _J.format("k") + " AS class_name, p AS param_count, code FROM wa")
def extract_methods(g: CodeGraph):
    """Methods with their code, read back from Java sources that Spark writes from the graph."""
    return _parsed(g)["methods"].select("name", "class_name", "param_count", "code").distinct()


@query(", ar AS (SELECT class_name, name, list(param_count) AS l FROM cg_method GROUP BY ALL) SELECT DISTINCT caller, " + _J.format("caller_class") + " AS caller_class, callee, " + _J.format("callee_class") + " AS callee_class, arg_count, type FROM cg_raw LEFT JOIN ar ON ar.class_name = callee_class AND ar.name = callee WHERE type = 'external' OR list_contains(l, arg_count) OR len(l) = 1")
def extract_calls(g: CodeGraph):
    """Call sites read back from the same sources."""
    return _parsed(g)["calls"].select("caller", "caller_class", "callee", "callee_class", "arg_count", "type").distinct()


def _with_offsets(g: CodeGraph) -> dict[str, DataFrame]:
    from .operators.extract import parse
    from .plans.sources_of_graph import write

    written = write(g).select("path", F.concat(F.lit('// ä€𝄞 "\n'), "content").alias("content"))
    return parse(save(written, "sources"), with_code=True)


@query(_WRITTEN + " SELECT file_path AS path, " + _J.format("k") + " AS class_name, m AS name, p AS param_count, 'void' AS return_type, first AS \"start\", CAST(first + length(code) AS INT) AS \"end\", code FROM ws")
def extract_code(g: CodeGraph):
    """Every method's code and offsets, behind letters of one to four bytes."""
    return _with_offsets(g)["methods"]


@query(_WRITTEN + ", wo AS (SELECT file_path, wl.*, ws.first, ws.front, ws.p, sum(length(line)) OVER (PARTITION BY wl.k, wl.m ORDER BY line ROWS UNBOUNDED PRECEDING) - length(line) AS before FROM wt wl JOIN ws ON ws.k = wl.k AND ws.m = wl.m AND ws.body <> ''), ok AS (SELECT class_name, name, list(param_count) AS l FROM cg_method GROUP BY ALL) SELECT file_path AS path, caller, " + _J.format("caller_class") + " AS caller_class, callee, arg_count, type, CAST(wo.first + length(front) + before + 4 AS INT) AS \"start\", CAST(wo.first + length(front) + before + length(c) AS INT) AS \"end\" FROM wo LEFT JOIN ok ON class_name = callee_class AND name = callee WHERE type = 'external' OR list_contains(l, arg_count) OR len(l) = 1")
def extract_call_offsets(g: CodeGraph):
    """Where every call begins and ends."""
    return _with_offsets(g)["calls"].select("path", "caller", "caller_class", "callee", "arg_count", "type", "start", "end")


@query(_WRITTEN + ", once AS (SELECT k, m, min(p) AS p FROM ws GROUP BY k, m) SELECT file_path || '::' || " + _J.format("k") + " || '::' || m AS id, code AS raw_code FROM ws JOIN once USING (k, m, p)")
def chunks_with_code(g: CodeGraph):
    """The chunks of the vector index with the raw code of their methods."""
    found = _with_offsets(g)["methods"]
    return vectors.with_code(found.select(F.col("path").alias("file_path"), "class_name", F.col("name").alias("method_name"), naming.chunk_id(F.col("path"), F.col("class_name"), F.col("name")).alias("id")).distinct(), found).select("id", "raw_code")


@query(", ar AS (SELECT class_name, name, list(param_count) AS l FROM cg_method GROUP BY ALL) SELECT caller, " + _J.format("caller_class") + " AS caller_class, callee, " + _J.format("callee_class") + " AS callee_class, arg_count, type, count(*) AS n FROM (SELECT DISTINCT * FROM cg_raw) LEFT JOIN ar ON ar.class_name = callee_class AND ar.name = callee WHERE type = 'external' OR list_contains(l, arg_count) OR len(l) = 1 GROUP BY ALL")
def extract_by_sql(g: CodeGraph):
    """P2, P15-P19 by the SQL table function, one group a path."""
    from .operators import extract
    from .plans.sources_of_graph import write

    spark = g.classes.sparkSession
    extract.register(spark)
    extract.piece_lists(write(g)).createOrReplaceTempView("java_pieces")
    return spark.sql("SELECT caller, class_name AS caller_class, name AS callee, callee_class, n AS arg_count, type, count(*) AS n FROM java_scopes(TABLE(java_pieces) PARTITION BY path ORDER BY i) WHERE kind = 'call' GROUP BY ALL")


@query("SELECT file_path AS path, " + _J.format("name") + " AS class_name, is_mapper, NOT is_mapper AS is_service FROM cg_class")
def extract_annotations(g: CodeGraph):
    """P7, F1."""
    from .operators.extract import annotated_classes
    from .plans.sources_of_graph import write

    return annotated_classes(write(g))


@query("SELECT DISTINCT file_path AS path, 'f' || " + _J.format("callee_class") + " AS field, " + _J.format("callee_class") + " AS type FROM cg_raw JOIN cg_class ON name = caller_class WHERE type = 'external' AND callee_class <> 'Unknown'")
def extract_injected(g: CodeGraph):
    """P5, P6, P13."""
    from .operators.extract import injected_fields
    from .plans.sources_of_graph import write

    return injected_fields(write(g))


@query("SELECT file_path AS path, 'java.util.List' AS name, 'List' AS simple FROM cg_class")
def extract_imports(g: CodeGraph):
    """P3, P4."""
    from .operators.extract import imports
    from .plans.sources_of_graph import write

    return imports(write(g))


@query("SELECT * FROM cg_calls")
def incremental_relink(g: CodeGraph):
    """The edge table brought up to date from an older state of one layer's classes equals a full run."""
    from .streaming.incremental import relink

    changed = g.classes.where("layer = 'util'").select(F.col("name").alias("class_name"))
    # Before: these classes had other parameters, called other methods, and one more method of each made calls.
    mine = lambda t, c: t.join(changed.withColumnRenamed("class_name", c), c, "left_semi").select(*t.columns)
    rest = lambda t, c: t.join(changed.withColumnRenamed("class_name", c), c, "left_anti").select(*t.columns)
    methods = rest(g.methods, "class_name").unionByName(mine(g.methods, "class_name").withColumn("param_count", (F.col("param_count") + 1) % 4).distinct())
    own = mine(g.raw_calls, "caller_class")
    raw = rest(g.raw_calls, "caller_class").unionByName(own.withColumn("arg_count", (F.col("arg_count") + 2) % 4)).unionByName(own.withColumn("caller", F.lit("no_longer_there")))
    before = linking.edges(linking.link(raw, methods))
    return relink(before, g.raw_calls, g.methods, changed)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents", graph=False)
def stream_hashes(spark, sf_dir):
    """The hash table of S2 kept by a file stream."""
    from .streaming.incremental import stream_hashes as run

    # A pattern, since a file stream takes a plain path for a folder.
    return run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/documents.parque[t]", "doc_id", "text")


from . import queries_products  # noqa: E402, F401  (registers its queries here)
