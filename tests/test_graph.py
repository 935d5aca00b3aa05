"""Traversals against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph as g


def reach(pairs, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in pairs:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(9)
    out = {(rng.randrange(30), rng.randrange(30)) for _ in range(34)} | {(40, 41), (41, 42), (42, 40), (50, 50), (42, 60), (60, 61)}
    return sorted(out)


@pytest.fixture(scope="module")
def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b, "CALLS", "{}") for i, (a, b) in enumerate(pairs)], "id bigint, source_id bigint, target_id bigint, type string, properties string")


@pytest.mark.parametrize("small", [0, 1000])
def test_components(spark, pairs, edges, small):
    far = {n: reach(pairs, n) for n in {x for p in pairs for x in p}}
    want = {n: min([m for m in far[n] if n in far[m]]) for n in far if n in far[n]}
    assert {r.id: r.component for r in g.components(edges, small=small).collect()} == want


def test_components_of_long_loops_take_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    ids = rng.sample(range(1000), 300)
    loop, tail, chain = ids[:200], ids[200:250], ids[250:]
    pairs = [*zip(loop, loop[1:] + loop[:1], strict=True), *zip(tail, [*tail[1:], loop[0]], strict=True), *zip([loop[7], *chain], chain, strict=False)]
    pairs += [(1000 + k, 1000 + (k + 1) % 150) for k in range(150)] + [(1000 + 5, tail[0]), (tail[3], tail[20])]
    rounds, write = [], g.written

    def counted(*args):
        rounds.append(args[1])
        assert len(rounds) <= 60
        return write(*args)

    monkeypatch.setattr(g, "written", counted)
    edges = spark.createDataFrame(pairs, "source_id bigint, target_id bigint")
    want = dict.fromkeys(loop, min(loop)) | dict.fromkeys(range(1000, 1150), 1000)
    got = g.components(edges, small=0).collect()
    assert {r.id: r.component for r in got} == want and len(got) == len(want)
    assert g.components(edges.limit(0)).count() == 0


def test_walk_takes_the_shortest_and_stops_at_hubs(spark):
    hops = spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (1, 3, "B"), (3, 4, "A"), (4, 1, "A")], "from_id bigint, to_id bigint, type string")
    start = spark.createDataFrame([(1,), (1,)], "id bigint")
    assert {(r.id, r.hop, r.parent_id) for r in g.walk(start, hops, 9).collect()} == {(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 3)}
    assert {r.id for r in g.walk(start, hops, 9, spark.createDataFrame([(3,)], "id bigint")).collect()} == {1, 2, 3}
    assert g.walk(start.limit(0), hops, 3).count() == 0


def test_change_plan(spark):
    before = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "c", "3"), ("p", "d", "9"), ("p", "e", "9"), ("p", "same", "5")], "project string, rel_path string, sha256 string")
    after = spark.createDataFrame([("p", "a", "8"), ("p", "moved", "2"), ("p", "x", "9"), ("p", "same", "5"), ("q", "c", "3")], "project string, rel_path string, sha256 string")
    got = {(r.project, r.rel_path): (r.change, r.old_path) for r in g.change_plan(before, after).collect()}
    assert got == {("p", "a"): ("modified", None), ("p", "moved"): ("renamed", "b"), ("p", "c"): ("deleted", None), ("q", "c"): ("added", None), ("p", "x"): ("added", None), ("p", "d"): ("deleted", None), ("p", "e"): ("deleted", None)}


def test_coverage_and_missed_graph(spark):
    nodes = spark.createDataFrame([("p", "a/x.go")], "project string, file_path string")
    gaps = spark.createDataFrame([("p", "a/y.go", "parse_partial"), ("p", "b/z.go", "not_indexed_ignored"), ("p", "a/y.go", "parse_partial")], "project string, rel_path string, kind string")
    files = spark.createDataFrame([("p", "a/x.go"), ("p", "a/y.go"), ("p", "c.go")], "project string, rel_path string")
    assert {r.rel_path: (r.status, r.kinds) for r in g.coverage(files, nodes, gaps).collect()} == {"a/x.go": ("complete", []), "a/y.go": ("partial", ["parse_partial"]), "c.go": ("not_indexed", [])}
    assert {tuple(r) for r in g.missed_graph(gaps).collect()} == {("p::missed", "a", "Folder"), ("p::missed", "a/y.go", "File")}


def test_implements(spark):
    methods = spark.createDataFrame([("T", "read"), ("T", "write"), ("U", "read")], "owner string, method string")
    interfaces = spark.createDataFrame([("R", "read"), ("RW", "read"), ("RW", "write"), ("RW", "write")], "owner string, method string")
    assert {tuple(r) for r in g.implements(methods, interfaces).collect()} == {("T", "R"), ("T", "RW"), ("U", "R")}
    assert g.hub_threshold(spark.createDataFrame([], "id bigint, source_id bigint, target_id bigint, type string")) == 50
    assert g.lookup(spark.createDataFrame([(1, "b", "a.b"), (2, "a.b", "x.a.b")], "id bigint, name string, qualified_name string"), "a.b").select(F.col("id")).collect()[0].id == 1


def test_search_and_text_of_an_expansion(spark):
    nodes = spark.createDataFrame([(1, "Function", "parseAll", "app.x.parseAll", "x.go", 3, 9), (2, "Method", "run", "app.y.run", "y.go", 4, 4), (3, "File", "z", "z", "z.go", 0, 0), (4, "Function", "far", "far", "f.go", 1, 2)], "id bigint, label string, name string, qualified_name string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([(1, 2, "CALLS"), (2, 3, "USES")], "source_id bigint, target_id bigint, type string")
    found = g.expand(nodes, edges, F.col("id") == 1)
    lines = g.rendered(nodes, found, budget=25).orderBy("place").collect()
    assert [r.line for r in lines] == ["NODE parseAll [qn=app.x.parseAll src=x.go loc=L3-9 community=app.x]", "NODE run [qn=app.y.run src=y.go loc=L4 community=app.y]", "NODE z [src=z.go loc=- community=z]"]
    assert [r.shown for r in lines] == [True, False, False] and all(r.shown for r in g.rendered(nodes, found).collect())
    assert g.rendered(nodes, found.limit(0)).count() == 0
    assert {(r.id, r.way) for r in g.search(nodes, edges, "parse").collect()} == {(1, "words")}
    assert {(r.id, r.way) for r in g.search(nodes, edges, labels=["method"]).collect()} == {(2, "structure")}
    near = spark.createDataFrame([(3, 0.9), (4, 0.5)], "id bigint, score double")
    assert [(r.id, r.way) for r in g.search(nodes, edges, semantic=near, limit=1).collect()] == [(3, "semantic")]
    assert {(r.id, r.way) for r in g.search(nodes, edges, "run", near).collect()} == {(2, "words"), (3, "semantic"), (4, "semantic")}
