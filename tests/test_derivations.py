import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import derivations as d
from marlstone.operators import memory as m
from marlstone.operators import sessions as s
from marlstone.sources import files as f


def test_resolve_calls(spark):
    symbols = spark.createDataFrame([(q,) for q in ("app.io.Read", "app.io.Write", "app.db.Write", "lib.x.Only", "app.main.run", "a.b.Deep", "c.b.Deep")], "qualified_name string")
    imports = spark.createDataFrame([("app.main", "io", "app.io"), ("app.main", "Only2", "lib.x")], "module string, alias string, target string")
    calls = spark.createDataFrame([(1, "app.main", "io.Read"), (2, "app.main", "run"), (3, "app.main", "Only"), (4, "app.main", "Write"), (5, "other", "b.Deep"), (6, "app.main", "nothing"), (7, "other", "Only"), (8, None, "Only")], "call_id int, module string, callee string")
    got = {r.call_id: (r.qualified_name, r.strategy, round(r.confidence, 3)) for r in d.resolve_calls(calls, symbols, imports).collect()}
    assert got == {1: ("app.io.Read", "import_map", 0.95), 2: ("app.main.run", "same_module", 0.9), 3: ("lib.x.Only", "unique_name", 0.75), 4: ("app.io.Write", "suffix_match", 0.55), 5: ("a.b.Deep", "qualified_suffix", 0.9), 7: ("lib.x.Only", "unique_name", 0.75), 8: ("lib.x.Only", "unique_name", 0.75)}


def test_config_links_routes_and_overrides(spark):
    keys = spark.createDataFrame([("database_url",), ("maxRetry-count",), ("url",), ("a_big_key",)], "name string")
    code = spark.createDataFrame([("DatabaseURL",), ("databaseUrl",), ("getDatabaseUrlOrDie",), ("MAX_RETRY_COUNT",)], "name string")
    assert {(r.key, r.symbol): r.confidence for r in d.config_links(keys, code).collect()} == {("database_url", "databaseUrl"): 0.85, ("database_url", "getDatabaseUrlOrDie"): 0.75, ("maxRetry-count", "MAX_RETRY_COUNT"): 0.85, ("database_url", "DatabaseURL"): 0.85}
    lines = spark.createDataFrame([("a.go", 1, 'r.GET("/users", list)'), ("a.go", 2, "app.handleFunc('/x', f)"), ("a.go", 3, "nothing")], "path string, line int, text string")
    assert {tuple(r) for r in d.routes(lines).collect()} == {("a.go", 1, "GET", "/users"), ("a.go", 2, "ANY", "/x")}
    methods = spark.createDataFrame([("A", "run"), ("B", "run"), ("B", "stop")], "owner string, method string")
    assert [tuple(r) for r in d.overrides(methods, spark.createDataFrame([("B", "A"), ("B", "A")], "child string, parent string")).collect()] == [("B", "A", "run")]


def test_seeds(spark):
    nodes = spark.createDataFrame([(1, "Function", "parse", "x.parse"), (2, "Function", "parseAll", "x.parseAll"), (3, "File", "reparse", "reparse"), (4, "Function", "other", "x.other")], "id int, label string, name string, qualified_name string")
    assert [r.id for r in d.seeds(nodes, "how does the parse work?").collect()] == [1] and d.query_terms("how does the parse work?") == ["parse"]
    assert [r.id for r in d.seeds(nodes, "the").collect()] == [4]  # of common words only: they are all there is to go by
    assert d.query_terms("find 'Foo.bar' at me to ab") == ["foo.bar", "foo", "bar"] and d.query_terms("calls using path") == ["calls", "using", "path"]


def test_similar_code(spark):
    rng = np.random.default_rng(0)
    base = [f"t{i}" for i in rng.integers(0, 500, 400)]
    near = [*base[:399], "changed"]
    rows = [("a", base), ("b", base), ("c", near), ("d", [f"u{i}" for i in range(100)]), ("e", base[:20]), (None, base)]
    got = {(r.source, r.target) for r in d.similar_code(spark.createDataFrame(rows, "qualified_name string, tokens array<string>"), least=0.9).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}


def test_files(spark, tmp_path):
    (tmp_path / "src" / "vendor").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("one\ntwo needle\nthree\n")
    (tmp_path / "src" / "vendor" / "b.py").write_text("needle")
    source = f.lines(spark, str(tmp_path)).cache()
    assert [(r.line, r.text) for r in f.grep(source, "needle").collect()] == [(2, "two needle")]
    assert f.grep(source, "^t", regex=True, glob="src/*.py").count() == 2 and f.grep(source, "one", glob="*.go").count() == 0
    assert [r.line for r in f.snippet(source, "src/a.py", 2, 2, 1).collect()] == [1, 2, 3]
    spans = spark.createDataFrame([("t", "s1", None, "x", 5, 6, {"k": "v"}, "", "one"), ("t", "s2", None, "x", 9, 9, None, "", "")], f.SPAN_SCHEMA)
    f.write_span_log(spans, str(tmp_path / "log"))
    f.write_span_log(spans, str(tmp_path / "log"))
    assert f.read_span_log(spark, str(tmp_path / "log") + "/*").count() == 4 and (tmp_path / "log" / "session=_inbox").exists()


def test_snapshots_and_pages(spark, tmp_path):
    snaps = f.Snapshots(spark, str(tmp_path / "snap"))
    snaps.publish(spark.range(3).toDF("id"))
    assert snaps.publish(spark.range(7).toDF("id"))["generation"] == 2
    assert snaps.read().count() == 7 and snaps.read(previous=True).count() == 3 and snaps.verify()
    df = spark.range(120).toDF("id")
    one, cursor = f.page(df, ["id"], "q", 1)
    two, _ = f.page(df, ["id"], "q", 1, cursor=cursor)
    assert [one.count(), two.first().id] == [50, 50]
    for bad, args in (("???", ("q", 1)), (cursor, ("other", 1)), (cursor, ("q", 2))):
        with pytest.raises(f.CursorError):
            f.page(df, ["id"], *args, cursor=bad)


EPISODE = "id bigint, uid string, session_id string, kind string, source string, title string, text string, topic string, tokens int, pinned int, faded int, centrality double, created_at string, updated_at string, valid_from string, valid_to string"


def episode(i, kind, text, topic="", session="s", tokens=100, valid_to=""):
    at = f"2025-01-01T00:00:{i:02d}Z"
    return (i, f"u{i}", session, kind, "agent", f"title {i}", text, topic, tokens, 0, 0, 0.1, at, at, "", valid_to)


def test_memory_roll_ups(spark):
    rows = [episode(1, "prompt", "first ask"), episode(2, "prompt", "Where is it?"), episode(3, "prompt", "last ask\nmore"), episode(4, "observation", "we chose x", "decision"), episode(5, "observation", "other", "change"), episode(6, "prompt", "", session="")]
    df = spark.createDataFrame(rows, EPISODE)
    made, edges = m.observations(df)
    assert {r.text for r in made.collect()} == {"first ask", "last ask\nmore"} and {r.target_id for r in edges.collect()} == {1, 3}
    assert [tuple(r) for r in m.session_rollups(df).collect()] == [("s", "request: last ask\nlearned: title 4 we chose x")]
    assert {r.id: r.centrality for r in m.reinforced(df, [1]).collect()}[1] == pytest.approx(0.15)


def test_recall_budget(spark):
    rows = [episode(i, "working", f"needle {i}", tokens=600) for i in range(1, 6)] + [episode(9, "working", "needle old", valid_to="2025-01-02T00:00:00Z")]
    got = m.recall(spark.createDataFrame(rows, EPISODE), "needle", 1735689600 * 10**9 + 5 * m.DAY).collect()
    assert sum(not r.stale for r in got) == 2 and [r.id for r in got if r.stale] == [9]


def test_session_details(spark):
    rows = [("s", "a", "x", 10, 11, {"vcs.ref.head.name": "main", "coding_agent.git.commit.sha": "c1", "coding_agent.git.commit.message": "old"}), ("s", "b", "edit", 2_000_010, 11, {"coding_agent.file_path": "f", "coding_agent.git.commit.sha": "c1", "coding_agent.git.commit.message": "new"}), ("s", "c", "x", 3_000_010, 11, {"coding_agent.file_path": "f", "coding_agent.git.pull_request.number": "7"})]
    spans = spark.createDataFrame(rows, "session string, span_id string, name string, start_time_unix_nano bigint, end_time_unix_nano bigint, attributes map<string,string>")
    r = s.version_control(spans).first()
    assert r.branch == "main" and [tuple(c) for c in r.commits] == [("c1", "new")] and r.pull_requests == ["7"]
    assert [(x.ms, x.state, x.visit) for x in s.replay(spans).orderBy("ms").collect()] == [(2, "edited", 1), (3, "seen", 2)]
    minute = 60 * 10**9
    spawns = spark.createDataFrame([("v", "p1", 0), ("v", "p2", minute), ("v", "p3", 20 * minute)], "vendor string, parent string, at bigint")
    starts = spark.createDataFrame([("v", "c1", 2 * minute), ("v", "c2", 3 * minute), ("v", "c3", 4 * minute), ("v", "c4", 30 * minute), ("w", "c5", 1)], "vendor string, child string, at bigint")
    assert {tuple(x) for x in s.claims(spawns, starts).collect()} == {("c1", "p1"), ("c2", "p2")}
    assert spawns.where(F.col("at") < 0).count() == 0
