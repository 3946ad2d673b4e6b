"""Steps of the report: calls are told once, by their edges; only the hop at which a chain breaks first is looked at for its reason."""

from kelpgraph.operators import chains, linking


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_edges_of_repeated_calls(spark):
    methods = spark.createDataFrame([("m", "C", 0), ("m", "C", 2), ("n", "D", 1)], "name string, class_name string, param_count int")
    rows = [("m", "C", "n", "D", 5, "external"), ("m", "C", "m", "C", 1, "internal"), ("m", "C", "m", "C", 2, "internal"), ("n", "D", "x", "Unknown", 0, "external"), ("", "D", "n", "D", 1, "internal")]
    raw = spark.createDataFrame(rows * 3, "caller string, caller_class string, callee string, callee_class string, arg_count int, type string")
    once, often = linking.edges(linking.link(raw, methods)), linking.edges(linking.linked(raw, methods))
    assert sorted(map(tuple, often.collect()), key=str) == sorted(map(tuple, once.collect()), key=str) == sorted([("m", "C", "n", "D", "external"), ("m", "C", "m", "C", "internal"), ("n", "D", "x", None, "unknown")], key=str)
    assert _exchanges(often) < _exchanges(once)


def test_reason_of_the_first_break(spark):
    nodes = spark.createDataFrame([("a", "C"), ("b", "C"), ("c", "C")], "name string, class_name string")
    known = spark.createDataFrame([("a", "C", "b", "C", "internal")] * 2, "caller string, caller_class string, callee string, callee_class string, type string")
    hops = {"full": "aba"[:2], "call": "abcx", "none": "abxc", "first": "xabc"}
    table = spark.createDataFrame([(n, [("C", m) for m in h]) for n, h in hops.items()], f"name string, hops {chains.HOPS}")
    got = {r.name: tuple(r)[1:] for r in chains.evaluate(table, known, nodes).select("name", "total_hops", "matched_hops", "full_hit", "first_break", "reason").collect()}
    assert got == {
        "full": (1, 1, True, None, None),
        "call": (3, 1, False, 1, "missing_call"),
        "none": (3, 1, False, 1, "missing_method_definition"),
        "first": (3, 1, False, 0, "missing_method_definition"),
    }
    flat = chains.matched(table, known)
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
