from marlstone.operators import graph as g
from marlstone.operators import memory as m
from marlstone.sources import store


def test_upserts_and_copies(spark):
    schema = "project string, qualified_name string, name string, n int"
    old = spark.createDataFrame([("p", "a", "x", 1), ("p", "b", "y", 1), (None, "c", "z", 1)], schema)
    new = spark.createDataFrame([("p", "a", "x2", 2), ("p", "a", "x3", 3), (None, "c", None, 4)], schema)
    assert {tuple(r) for r in store.upserted(old, new, store.NODE_KEY, "n").collect()} == {("p", "a", "x3", 3), ("p", "b", "y", 1), (None, "c", None, 4)}
    got = store.copied(old.select("qualified_name", "name"), spark.createDataFrame([("a", "q"), ("d", "w")], "qualified_name string, name string"), "qualified_name")
    assert {tuple(r) for r in got.collect()} == {("a", "x"), ("b", "y"), ("c", "z"), ("d", "w")}


def test_traces_and_listing(spark):
    edges, counts = store.ingested_traces(spark.createDataFrame([("a", "b", None), ("a", "", "X"), (None, "b", "X"), ("c", "d", "USAGE")], "source string, target string, type string"))
    assert {tuple(r) for r in edges.collect()} == {("a", "b", "CALLS"), ("c", "d", "USAGE")} and tuple(counts.first()) == (2, 2)
    nodes = spark.createDataFrame([("p", "f.go"), ("p", "f.go"), ("p::missed", "x"), ("q", "")], "project string, file_path string")
    links = spark.createDataFrame([("p",), ("p",)], "project string")
    assert {tuple(r) for r in store.projects(nodes, links).collect()} == {("p", 2, 2, 1), ("q", 1, 0, 0)}
    assert store.without_project(nodes, "p").count() == 1


def test_communities_and_topics(spark):
    nodes = spark.createDataFrame([(i, "Function", f"a.b.{'x' if i < 5 else 'y'}.f{i}") for i in range(10)], "id bigint, label string, qualified_name string")
    pairs = [(a, b) for block in (range(5), range(5, 10)) for a in block for b in block if a < b] + [(0, 5)]
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "source_id bigint, target_id bigint, type string")
    assert {(r.community, r.members, r.name, round(r.cohesion, 3)) for r in g.community_report(nodes, edges).collect()} == {(0, 5, "x", 0.909), (5, 5, "y", 0.909)}
    links = spark.createDataFrame([(1, 2, 1.0), (2, 1, 0.5)], "source_id bigint, target_id bigint, weight double")
    vectors = spark.createDataFrame([(7, [1, 0]), (8, [9, 1]), (9, [0, 1])], "episode_id bigint, vector array<int>")
    assert {(r.a, r.b, round(r.w, 2)) for r in m.topic_edges(links, vectors).collect()} == {(1, 2, 1.5), (7, 8, 0.99)}
    found = spark.createDataFrame([(1, 10), (2, 10), (3, 30)], "id bigint, community bigint")
    before = spark.createDataFrame([(1, 77), (2, 77), (3, 77)], "id bigint, community bigint")
    assert {tuple(r) for r in m.stable_labels(found, before).collect()} == {(1, 77), (2, 77), (3, 30)}
