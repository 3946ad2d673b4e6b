"""Operators on small tables with results worked out by hand."""

import itertools
import random

from pyspark.sql import functions as F

from kelpgraph.functions import naming
from kelpgraph.operators import chains, entries, extract, inference, linking, quality, traverse, vectors
from kelpgraph.sources import files, sinks
from kelpgraph.streaming import incremental

JAVA = '''
package a.b; // class Ghost { void no() {} }
import java.util.List;
import static a.B.c;
import a.c.*;
/** @Service class Doc */
@Service("x")
public class Order extends Base {
  @Autowired
  private
    UserService<Map<String, Integer>> users;
  private final Dao dao = new Dao();
  @Value("${a}") String plain;
  public Order(Dao d) { d.init(); }
  public List<User> list(String q, int... more) {
    String s = "call(1, 2) { } // no";
    Helper.help(s, '{');
    users.find(q, other(more), x -> { dao.one(); dao.two(1, 2); });
    this.dao.save();
    this.other(1);
    make().run();
    new Task(1).start();
    ghost.vanish();
    missing();
    for (User u : users.all()) { u.touch(); }
    return null;
  }
  int other(int a) { if (a > 1) { return list("x").size(); } return 0; }
  Worker make() { return null; }
  class Inner { void deep(Dao e) { e.x(); } }
  void after() { users.last(); }
}
interface Port { void send(String a, int b); }
'''


def parsed(spark):
    return extract.parse(spark.createDataFrame([("p/Order.java", JAVA)], "path string, content string"))


def test_extracts_methods(spark):
    got = {tuple(r) for r in parsed(spark)["methods"].select("class_name", "name", "param_count", "return_type").collect()}
    assert got == {("Order", "list", 2, "List"), ("Order", "other", 1, "int"), ("Order", "make", 0, "Worker"), ("Inner", "deep", 1, "void"), ("Order", "after", 0, "void"), ("Port", "send", 2, "void")}


def test_extracts_calls(spark):
    got = {tuple(r) for r in parsed(spark)["calls"].select("caller_class", "caller", "callee_class", "callee", "arg_count", "type").collect()}
    assert got == {
        ("Order", "list", "Helper", "help", 2, "external"), ("Order", "list", "UserService", "find", 3, "external"), ("Order", "list", "Order", "other", 1, "internal"),
        ("Order", "list", "Dao", "one", 0, "external"), ("Order", "list", "Dao", "two", 2, "external"), ("Order", "list", "Dao", "save", 0, "external"),
        ("Order", "list", "Order", "make", 0, "internal"), ("Order", "list", "Worker", "run", 0, "external"), ("Order", "list", "Task", "start", 0, "external"),
        ("Order", "list", "Unknown", "vanish", 0, "external"), ("Order", "list", "UserService", "all", 0, "external"), ("Order", "list", "User", "touch", 0, "external"),
        ("Order", "other", "Order", "list", 1, "internal"), ("Order", "other", "List", "size", 0, "external"), ("Inner", "deep", "Dao", "x", 0, "external"), ("Order", "after", "UserService", "last", 0, "external"),
    }


def test_extracts_annotations_imports_and_injection(spark):
    df = spark.createDataFrame([("p", JAVA)], "path string, content string")
    assert [r.name for r in extract.imports(df).collect()] == ["java.util.List"]
    assert {(r.class_name, r.is_service) for r in extract.annotated_classes(df).collect()} >= {("Order", True)}
    assert [(r.field, r.type) for r in extract.injected_fields(df).collect()] == [("users", "UserService")]


def test_scan_skips_directories(spark, tmp_path):
    for name in ("a/X.java", "target/Y.java", "a/Z.JAVA", "a/n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"class X {} \xff")
    got = files.scan(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["X.java"] and len(got[0].sha256) == 64


def test_delta_states(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "path string, sha256 string")
    before = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "3")], "path string, sha256 string")
    assert {tuple(r) for r in files.delta(now, before).collect()} == {("b", "changed"), ("d", "new"), ("c", "removed")}
    assert files.load_or_empty(spark, "/nowhere/at/all", "path string, sha256 string").count() == 0


def test_naming(spark):
    df = spark.createDataFrame([("/src/a/SERVICE/x/dal/T.java", "T"), ("C:\\p\\orders\\dao\\T.java", "T"), ("/x/action/controller/A.java", "A"), ("/T.java", "FooDao"), (None, None)], "p string, c string")
    got = df.select(naming.layer(F.col("p")), naming.domain(F.col("p")), naming.coarse_bucket(F.col("p"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("service", "x", "db"), ("dao", "orders", "db"), ("action", "x", "ui"), ("other", "other", "db"), ("other", "other", "other")]
    over = spark.createDataFrame([("/a/b/c/X", "/a/b/d/Y"), ("/a/X", "/b/Y"), ("X", "Y"), ("/a/b/X", "/a/b/Y")], "x string, y string")
    assert [r[0] for r in over.select(naming.path_overlap(F.col("x"), F.col("y"))).collect()] == [3, 1, 0, 3]
    names = spark.createDataFrame([("a.b.Foo<Bar>",), ("Foo<a.b>",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(naming.type_name(F.col("n"))).collect()] == ["Foo", "b>", "Object", "Object"]
    cats = spark.createDataFrame([("", "trim", "A"), ("", "getTime", "A"), ("jdk_unknown", "getTime", "A"), ("", "logInfo", "A"), ("", "x", "BaseThing"), (None, "x", None), ("third_party_lib", "trim", "A")], "s string, n string, c string")
    assert [r[0] for r in cats.select(naming.unknown_category(F.col("s"), F.col("n"), F.col("c"))).collect()] == ["jdk_core", "true_unresolved", "jdk_core", "infra_framework", "internal_shared_lib_missing", "true_unresolved", "third_party_lib"]


def test_link_modes(spark):
    methods = spark.createDataFrame([("m", "A", 0), ("m", "A", 3), ("k", "A", 2)], "name string, class_name string, param_count int")
    raw = spark.createDataFrame([("c", "X", "m", "A", 0, "external"), ("c", "X", "m", "A", 1, "external"), ("c", "X", "k", "A", 9, "external"), ("c", "X", "z", "A", 0, "external"), ("c", "X", "y", "X", 0, "internal"), ("", "X", "m", "A", 0, "external")], "caller string, caller_class string, callee string, callee_class string, arg_count int, type string")
    got = {(r.callee, r.arg_count): (r.mode, r.arity) for r in linking.link(raw, methods, tolerance=1).collect()}
    assert got == {("m", 0): ("exact", 0), ("m", 1): ("tolerant", 0), ("k", 9): ("fallback", 2), ("z", 0): ("none", None), ("y", 0): ("none", None)}
    assert {tuple(r) for r in linking.edges(linking.link(raw, methods)).collect()} == {("c", "X", "m", "A", "external"), ("c", "X", "k", "A", "external"), ("c", "X", "z", None, "unknown"), ("c", "X", "m", None, "unknown")}


def test_inference_passes(spark):
    unknown = spark.createDataFrame([("a", "X", "one"), ("a", "X", "two"), ("a", "X", "far"), ("a", "X", "nil")], "caller string, caller_class string, callee string")
    methods = spark.createDataFrame([("one", "P", 0), ("two", "P", 0), ("two", "Q", 0), ("far", "Q", 0), ("far", "R", 0)], "name string, class_name string, param_count int")
    classes = spark.createDataFrame([("X", "a/b/X.java", False), ("P", "a/c/P.java", False), ("Q", "z/Q.java", True), ("R", "y/R.java", False)], "name string, file_path string, is_mapper boolean")
    got = {(r.callee, r.callee_class, r.reason, r.confidence) for r in inference.infer(unknown, methods, classes).collect()}
    assert got == {("one", "P", "unique_name", 1.0), ("two", "P", "path_proximity:1", 0.45), ("far", "Q", "mybatis_mapper", 0.8)}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "external") for a, b in pairs], "s string, d string, type string")


def test_reach_meets_its_source_on_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "a")])
    src = spark.createDataFrame([("a", "a")], "origin string, node string")
    assert {(r.node, r.depth, r.via) for r in traverse.reach(e, src, 9).collect()} == {("b", 1, "a"), ("c", 1, "a"), ("a", 2, "c")}
    assert {(r.node, r.depth) for r in traverse.reach(e, src, 1, up=True).collect()} == {("c", 1), ("x", 1)}
    assert {r.node for r in traverse.reachable(e, src).collect()} == {"a", "b", "c"}
    assert traverse.reach(e, src.limit(0), 3).count() == 0


def test_shortest_path_and_tree(spark):
    e = edges(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "a")])
    src = spark.createDataFrame([("a", "a")], "origin string, node string")
    assert traverse.shortest_path(e, src, "d").first()["path"] == ["a", "b", "d"]
    assert traverse.shortest_path(e, src, "a").first()["path"] == ["a"]
    assert traverse.shortest_path(e, src, "nowhere").count() == 0
    tree = traverse.call_tree(e, src.select(F.col("node").alias("root")), 3)
    assert {("".join(r.path), r.truncated) for r in tree.collect()} == {("a", None), ("ab", None), ("ac", None), ("abd", None), ("acd", None), ("abda", "cycle"), ("acda", "cycle")}
    assert traverse.budgeted(tree, 3).count() == 3


def test_chains(spark):
    raw = spark.createDataFrame([("ok", ['["A","m"]', '{"class":"B","method":"n"}']), ("short", ['["A","m"]', '["",""]']), ("cut", ['["A","m"]', '["Z","q"]', '["B","n"]'])], "name string, hops array<string>")
    chain = chains.normalised(raw)
    known = spark.createDataFrame([("m", "A", "n", "B", "internal")], "caller string, caller_class string, callee string, callee_class string, type string")
    nodes = spark.createDataFrame([("m", "A"), ("n", "B")], "name string, class_name string")
    got = {r.name: (r.full_hit, r.matched_hops, r.first_break, r.reason) for r in chains.evaluate(chain, known, nodes).collect()}
    assert got == {"ok": (True, 1, None, None), "cut": (False, 0, 0, "missing_method_definition")}


def test_suggested_chain_prefers_role_and_stops(spark):
    known = spark.createDataFrame([("go", "WebAction", "do", "OrderService", "external"), ("go", "WebAction", "h", "Helper", "internal"), ("do", "OrderService", "put", "OrderDao", "external"), ("put", "OrderDao", "go", "WebAction", "external")], "caller string, caller_class string, callee string, callee_class string, type string")
    e = spark.createDataFrame([("go", "WebAction", 20)], "name string, class_name string, entry_score int")
    got = chains.suggest(e, known).collect()
    assert [[h["class"] for h in r.hops] for r in got] == [["WebAction", "OrderService", "OrderDao"]]


def test_entry_rules(spark):
    nodes = spark.createDataFrame([("execute", "PayAction"), ("getX", "Pojo")], "name string, class_name string")
    classes = spark.createDataFrame([("PayAction", "/w/action/web/PayAction.java"), ("Pojo", "/w/model/Pojo.java")], "name string, file_path string")
    calls = spark.createDataFrame([("execute", "PayAction", f"m{i}", "B", "external") for i in range(3)], "caller string, caller_class string, callee string, callee_class string, type string")
    got = {r.name: (r.entry_score, r.entry_confidence, [t.rule for t in r.entry_rule_trace]) for r in entries.scored(nodes, classes, calls).collect()}
    assert got["execute"][:2] == (8 + 4 + 8 + 7 + 1 + 2, "high")
    assert got["getX"] == (-3, "low", ["method.prefix_entry_like", "penalty.getter_setter_no_fanout"])


def test_metric_change_and_gate(spark):
    now = spark.createDataFrame([("broken_chain_rate", 0.5), ("reachability_rate", 0.8)], "metric string, value double")
    before = spark.createDataFrame([("broken_chain_rate", 0.25)], "metric string, value double")
    assert [tuple(r) for r in quality.change(now, before).collect()] == [("broken_chain_rate", 0.25, 0.5, 0.25)]
    passed = {r.metric: r.passed for r in quality.gate(now).collect()}
    assert passed["reachability_rate"] and not passed["broken_chain_rate"] and not passed["key_chain_hit_rate"]
    assert quality.hints(now).count() == 1
    assert {r.metric for r in quality.gate(now, {"broken_chain_rate": 0.6}).where("not mandatory and passed").collect()} == {"broken_chain_rate"}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_relink_equals_a_full_run(spark):
    raw = spark.createDataFrame([("c", "X", "m", "A", 0, "external"), ("d", "A", "m", "A", 0, "internal"), ("e", "Y", "q", "Y", 0, "internal")], "caller string, caller_class string, callee string, callee_class string, arg_count int, type string")
    before = spark.createDataFrame([("m", "A", 0), ("q", "Y", 0)], "name string, class_name string, param_count int")
    after = spark.createDataFrame([("m", "A", 1), ("m", "A", 2), ("q", "Y", 0)], "name string, class_name string, param_count int")
    stored = linking.edges(linking.link(raw, before))
    changed = spark.createDataFrame([("A",)], "class_name string")
    assert {tuple(r) for r in incremental.relink(stored, raw, after, changed).collect()} == {tuple(r) for r in linking.edges(linking.link(raw, after)).collect()}


def test_stream_keeps_the_latest(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = incremental.stream_hashes(spark, str(tmp_path / "in"), str(tmp_path / "in"), "k", "t")
    assert got.count() == 2


def test_top_k_and_context(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [5.0, 0.0], "b")], "vec_id long, embedding array<float>, layer string")
    q = spark.createDataFrame([(9, [0.9, 0.0], "a")], "query_id long, q array<float>, layer string")
    assert [r.vec_id for r in vectors.top_k(v, q, 2).orderBy("rank").collect()] == [2, 1]
    assert {r.vec_id for r in vectors.top_k(v, q, 5, same="layer").collect()} == {1, 2}


def test_reachability_goes_down_to_the_default_depth(spark, monkeypatch):
    from types import SimpleNamespace

    from kelpgraph import queries

    n = 8
    classes = spark.createDataFrame([(f"C{i}", f"/src/{'controller' if i == 0 else 'misc'}/C{i}.java", "x", False) for i in range(n)], "name string, file_path string, layer string, is_mapper boolean")
    nodes = spark.createDataFrame([(f"m{i}", f"C{i}") for i in range(n)], "name string, class_name string")
    calls = spark.createDataFrame([(f"m{i}", f"C{i}", f"m{i + 1}", f"C{i + 1}", 0, "external") for i in range(n - 1)], "caller string, caller_class string, callee string, callee_class string, arg_count int, type string")
    monkeypatch.setattr(queries, "from_tables", lambda spark, sf_dir: SimpleNamespace(classes=classes, nodes=nodes, calls=calls, known=calls))
    sf = "/root/testdata/sf0.001"
    assert {r.node for r in queries.Q["reachable_methods"](spark, sf).collect()} == {f"C{i}.m{i}" for i in range(n)}
    assert {r.metric: r.value for r in queries.Q["quality_metrics"](spark, sf).collect()}["reachability_rate"] == 1
    assert {r.metric: r.passed for r in queries.Q["threshold_gate"](spark, sf).collect()}["reachability_rate"]


def test_every_vector_query_is_answered(spark, monkeypatch):
    from kelpgraph import queries

    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 10)  # several blocks
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    for name, same in (("vector_topk_every", False), ("vector_topk_filtered_every", True)):
        want = {}
        for q in rows:
            if q.vec_id % 20 == 0:
                found = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(v.embedding, q.embedding, strict=True)), v.vec_id) for v in rows if not same or v.label == q.label)
                want[q.vec_id] = [i for _, i in found[:5]]
        got = {}
        df = queries.Q[name](spark, sf)
        assert "BroadcastNestedLoopJoin" in df._jdf.queryExecution().toString() or same
        for r in df.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want and len(want) > 10


def test_traversals_from_every_method_to_the_default_depth(spark, monkeypatch):
    from types import SimpleNamespace

    from kelpgraph import queries

    names = ["A.z", *(f"B{i}.m" for i in range(6))]  # A.a comes first and calls nothing
    classes = spark.createDataFrame([("A", "controller")], "name string, layer string")
    nodes = spark.createDataFrame([("a", "A")] + [tuple(x.split(".")[::-1]) for x in names], "name string, class_name string")
    calls = spark.createDataFrame([(*a.split("."), *b.split("."), "external") for a, b in zip(names, names[1:], strict=False)], "caller_class string, caller string, callee_class string, callee string, type string")
    back = calls.selectExpr("callee_class caller_class", "callee caller", "caller_class callee_class", "caller callee", "type")
    graph = lambda known: lambda spark, sf_dir: SimpleNamespace(classes=classes, nodes=nodes, known=known)
    monkeypatch.setattr(queries, "from_tables", graph(calls))
    assert {(r.origin, r.node, r.depth) for r in queries.Q["downstream_every"](spark, "").collect()} == {("A.z", x, i) for i, x in enumerate(names) if i}
    assert [(r.origin, r.path) for r in queries.Q["data_flow_path_every"](spark, "").collect()] == [("A.z", " > ".join(names))]
    monkeypatch.setattr(queries, "from_tables", graph(back))
    assert {(r.origin, r.node, r.depth) for r in queries.Q["upstream_every"](spark, "").collect()} == {("A.z", x, i) for i, x in enumerate(names) if i}


def test_first_of_tree_is_the_budgeted_tree(spark):
    """Against a walk in depth-first order, with cycles, leaves, ties by name and budgets that end in any place."""
    rng = random.Random(7)
    pairs = sorted({(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(60)})
    children = {}
    for a, b in pairs:
        children.setdefault(a, []).append(b)

    def walk(path, depth, fan_out, limit):
        yield path
        if path[-1] in path[:-1] or depth == limit:
            return
        for child in children.get(path[-1], [])[:fan_out]:
            yield from walk([*path, child], depth + 1, fan_out, limit)

    roots = spark.createDataFrame([(f"n{i:02}",) for i in range(14)] + [("absent",), ("n00",)], "root string")
    e = edges(spark, pairs)
    for depth, fan_out, most in ((6, 3, 25), (10, 100, 40), (2, 2, 1000), (4, 100, 1)):
        got = traverse.first_of_tree(e, roots, depth, fan_out, most).collect()
        want = {(p[0], place, tuple(p)) for r in {*(f"n{i:02}" for i in range(14)), "absent"} for place, p in enumerate(itertools.islice(walk([r], 0, fan_out, depth), most), 1)}
        assert {(r.root, r.place, tuple(r.path)) for r in got} == want and len(got) == len(want)
        for r in got:
            assert r.truncated == ("cycle" if r.node in r.path[:-1] else "max_depth" if r.depth == depth else None)
