"""The build from source files: full, incremental, and asked by the command line."""

from kelpgraph.__main__ import main
from kelpgraph.plans import build

ACTION = "package w; public class PayAction { private PayService service; public void execute() { service.pay(1); log(); } void log() {} }"
SERVICE = "@Service public class PayService { PayDao dao; public void pay(int a) { dao.put(a); ghost.gone(); } }"
DAO = "@Mapper public interface PayDao { void put(int a); }"


def rows(df):
    return {tuple(r) for r in df.collect()}


def write(base, name, text):
    (base / name).parent.mkdir(parents=True, exist_ok=True)
    (base / name).write_text(text)


def test_build_and_incremental_equal_a_full_build(spark, tmp_path, capsys):
    src, out, full = tmp_path / "src", str(tmp_path / "graph"), str(tmp_path / "full")
    for name, text in (("action/PayAction.java", ACTION), ("service/PayService.java", SERVICE), ("dao/PayDao.java", DAO)):
        write(src, name, text)
    assert {r.status for r in build.build(spark, str(src), out, incremental=True).collect()} == {"new"}
    g = build.load(spark, out)
    assert rows(g.calls.select("caller_class", "caller", "callee_class", "callee", "type")) == {
        ("PayAction", "execute", "PayService", "pay", "external"), ("PayAction", "execute", "PayAction", "log", "internal"),
        ("PayService", "pay", "PayDao", "put", "external"), ("PayService", "pay", None, "gone", "unknown"),
    }
    assert {(r.name, r.layer, r.is_mapper) for r in g.classes.collect()} == {("PayAction", "action", False), ("PayService", "service", False), ("PayDao", "dao", True)}
    assert build.build(spark, str(src), out, incremental=True).count() == 0

    write(src, "dao/PayDao.java", DAO.replace("int a", "int a, int b"))
    write(src, "service/PayService.java", SERVICE.replace("ghost.gone();", ""))
    changed = build.build(spark, str(src), out, incremental=True)
    assert {(r.path.rsplit("/", 1)[1], r.status) for r in changed.collect()} == {("PayDao.java", "changed"), ("PayService.java", "changed")}
    build.build(spark, str(src), full)
    assert rows(build.load(spark, out).calls) == rows(build.load(spark, full).calls)

    main(["downstream", out, "PayAction.execute"])
    assert "PayDao.put" in capsys.readouterr().out
    main(["report", out])
    assert "broken_chain_rate" in capsys.readouterr().out
    main(["docs", out, str(tmp_path / "docs")])
    assert any("PayDao" in f.read_text() for f in (tmp_path / "docs").glob("part-*"))


def test_incremental_build_parses_changed_files_only(spark, tmp_path, monkeypatch):
    src, out, full = tmp_path / "src", str(tmp_path / "graph"), str(tmp_path / "full")
    write(src, "action/PayAction.java", ACTION)
    write(src, "dao/PayDao.java", DAO)
    write(src, "util/Old.java", "class Old { void gone() { put(1); } void put(int a) { } }")
    build.build(spark, str(src), out, incremental=True)
    (src / "util/Old.java").unlink()
    write(src, "service/PayService.java", SERVICE)
    write(src, "action/PayAction.java", ACTION.replace("void log() {}", "void note() {}"))
    seen = []
    real = build.extract.parse
    monkeypatch.setattr(build.extract, "parse", lambda files: seen.extend(r.path.rsplit("/", 1)[1] for r in files.collect()) or real(files))
    changed = {r.path.rsplit("/", 1)[1]: r.status for r in build.build(spark, str(src), out, incremental=True).collect()}
    assert changed == {"Old.java": "removed", "PayService.java": "new", "PayAction.java": "changed"}
    assert sorted(seen) == ["PayAction.java", "PayService.java"]
    build.build(spark, str(src), full)
    a, b = build.load(spark, out), build.load(spark, full)
    assert rows(a.calls) == rows(b.calls) and rows(a.methods) == rows(b.methods) and rows(a.classes) == rows(b.classes)
    assert ("execute", "PayAction", "pay", "PayService", "external") in rows(a.calls.select("caller", "caller_class", "callee", "callee_class", "type"))


def test_inferred_edges_replace_unknown_ones(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "graph")
    write(src, "service/PayService.java", SERVICE)
    write(src, "misc/Other.java", "class Other { void gone() { } }")
    build.build(spark, str(src), out)
    got = rows(build.load(spark, out).calls.select("caller", "callee", "callee_class", "type"))
    assert ("pay", "gone", "Other", "external") in got and not any(t == "unknown" and c == "gone" for _, c, _, t in got)


def test_rules_of_a_file(spark, tmp_path):
    from kelpgraph.operators import extract
    from kelpgraph.sources import files

    (tmp_path / "rules.json").write_text('{"mapper_annotations": ["Table"], "injection_annotations": ["Give"]}')
    rules = files.load_rules(spark, str(tmp_path / "rules.json"))
    assert rules == {"mapper_annotations": ["Table"], "injection_annotations": ["Give"]}
    assert files.load_rules(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "bad.json").write_text("not json")
    assert files.load_rules(spark, str(tmp_path / "bad.json")) == {}
    df = spark.createDataFrame([("p", "@Table class A { @Give Dao dao; } @Mapper class B { @Autowired Dao other; }")], "path string, content string")
    assert {(r.class_name, r.is_mapper) for r in extract.annotated_classes(df, rules).collect()} == {("A", True)}
    assert [r.field for r in extract.injected_fields(df, rules).collect()] == ["dao"]


def test_the_hash_stream_goes_on_after_a_restart(spark, tmp_path):
    from kelpgraph.streaming.incremental import stream_hashes

    src, state = tmp_path / "in", str(tmp_path / "state")
    put = lambda name, rows: spark.createDataFrame(rows, "k long, c string").coalesce(1).write.parquet(str(src / name))
    run = lambda: {r.k: r.sha256[:6] for r in stream_hashes(spark, str(src / "a"), str(src / "*"), "k", "c", state).collect()}
    put("a", [(1, "x"), (2, "y")])
    first = run()
    assert set(first) == {1, 2} and run() == first
    put("b", [(2, "z"), (3, None)])
    second = run()
    assert set(second) == {1, 2, 3} and second[1] == first[1] and second[2] != first[2] and run() == second
    # Cut off while a batch was written: what it left is no version, and the batch before still counts.
    (tmp_path / "state" / "v7").mkdir()
    put("c", [(4, "q"), (4, "r"), (4, "q")])
    third = run()
    assert {k: third[k] for k in second} == second and set(third) == {1, 2, 3, 4}


def test_settings(monkeypatch):
    monkeypatch.setenv("A", "x")
    monkeypatch.setenv("B", "Yes")
    assert build.setting("A", 3) == 3 and build.setting("NONE", 4) == 4 and build.switched_on("B") and not build.switched_on("A")
