"""The Cypher subset on a two-node graph: parsing, two-valued logic, quirks."""

import pytest

from marlstone.plans.cypher import Graph, cypher
from marlstone.plans.cypher_syntax import CypherError, parse


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [(1, "fixture", "Function", "RefreshAll", "graph.RefreshAll", "graph/graph.go", 91, 130, '{"loc": 40, "tag": "x"}'), (2, "fixture", "Function", "BuildAll", "graph.BuildAll", "graph/graph.go", 73, 89, '{"loc": "17"}'), (3, "fixture", "File", "graph.go", "graph.go", "", None, None, None)],
        "id bigint, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string",
    )
    edges = spark.createDataFrame([(10, 1, 2, "CALLS", '{"w": 2}'), (11, 3, 1, "DEFINES", None), (12, 3, 2, "DEFINES", None), (13, 2, 2, "CALLS", "{}")], "id bigint, source_id bigint, target_id bigint, type string, properties string")
    return Graph(nodes, edges)


def rows(graph, text, **params):
    return [tuple(r) for r in cypher(graph, text, params).collect()]


COUNTS = [
    ('MATCH (f:Function) WHERE f.name CONTAINS "All" RETURN f.name', 2), ('MATCH (f:Function) WHERE f.name ENDS WITH "All" RETURN f.name', 2), ('MATCH (f:Function) WHERE f.name NOT IN ["BuildAll"] RETURN f.name', 1),
    ("MATCH (f:Function) WHERE f:Function AND f.missing IS NULL RETURN f.name", 2), ("MATCH (f) WHERE f.file_path IS NOT NULL RETURN f.name", 2), ("MATCH (f:function) RETURN DISTINCT f.label", 1),
    ("MATCH (f:Function) WITH DISTINCT f.label AS label RETURN label", 1), ('MATCH (f:Function) WHERE coalesce(f.missing, "fallback") = "fallback" RETURN f.name', 2), ('MATCH (f:Function) WHERE substring(f.name, 0, 5) = "Build" RETURN f.name', 1),
    ('MATCH (f:Function) WHERE NOT f.name = "BuildAll" RETURN f.name', 1), ("MATCH (f:Function) WHERE f.in_degree = 0 AND f.out_degree = 1 RETURN f.name", 1), ("MATCH (f:Function) WHERE f.loc > 20 RETURN f", 1), ("MATCH (f:Function) WHERE f.loc = '17.0' RETURN f", 1),
    ("MATCH (f) WHERE f.loc <> 40 RETURN f", 2), ("MATCH (f) WHERE f.loc = null RETURN f", 1), ("MATCH (f) WHERE f.nope < 'z' RETURN f", 3), ("MATCH (a)-[r]->(b) RETURN a", 4), ("MATCH (a)-[r]-(b) RETURN a", 7), ("MATCH (a)-[:CALLS*]->(b) RETURN b", 3),
    ("MATCH (a)-[*0..1]->(b) RETURN b", 7), ("MATCH (a)-[*0]->(b) RETURN b", 11), ("MATCH (a)-[r {w: 2}]->(b) RETURN a", 1), ("MATCH (a)-[r {w: $w}]->(b) RETURN a", 0), ("MATCH (a {loc: $w}) RETURN a", 1), ("MATCH (a)-[:CALLS]->(a) RETURN a", 1),
    ("MATCH (a)-[:DEFINES]->(b)-[:CALLS]->(c) RETURN a", 2), ("MATCH (a:File), (b:Function) RETURN a", 2), ("MATCH (a:File) OPTIONAL MATCH (a)-[:CALLS]->(b) WHERE b IS NULL RETURN a", 1), ("MATCH (a) WHERE EXISTS { (a)-[:CALLS]->(:Function) } OR a:File RETURN a", 3),
    ("MATCH (a) RETURN a.name LIMIT 0", 3), ("MATCH (a) RETURN a.name SKIP 1 LIMIT 1", 1), ("UNWIND [] AS x RETURN x", 0), ("MATCH (a) WHERE a.start_line XOR a:File RETURN a", 3), ("MATCH (a) -- comment\n RETURN a.name", 3), ("MATCH (a) /* x */ RETURN a.name // y", 3),
]


@pytest.mark.parametrize(("text", "count"), COUNTS)
def test_counts(graph, text, count):
    assert len(rows(graph, text, w=40)) == count


def test_values(graph):
    assert rows(graph, "MATCH (f:Function) RETURN sum(f.loc) AS s, avg(f.loc) AS a, max(f.loc) AS m, count(f.nope) AS n") == [(57.0, 28.5, "40", 0)]
    assert rows(graph, "MATCH (f:Nope) RETURN f.name, count(*), sum(f.x), collect(f.name)") == [(None, 0, 0.0, [])]
    assert rows(graph, "MATCH (f:Nope) RETURN count(DISTINCT *)") == [(0,)] and rows(graph, "MATCH (f) RETURN count(DISTINCT *)") == [(1,)]
    assert rows(graph, "MATCH (f) RETURN f.name ORDER BY f.start_line") == [("BuildAll",), ("RefreshAll",), ("graph.go",)]
    assert rows(graph, "MATCH (f:Function) WITH f, f.loc AS n ORDER BY n DESC LIMIT 1 RETURN f.name, n, labels(f), keys(f)") == [("RefreshAll", "40", ["Function"], ["file_path", "label", "loc", "name", "qualified_name", "tag"])]
    assert rows(graph, "MATCH (a:File) OPTIONAL MATCH (a)-[:CALLS]->(b) RETURN b.name, id(b), labels(b), b:Function") == [(None, None, [], False)]
    assert rows(graph, "RETURN toInteger('3.7') AS a, toInteger('12') AS b, toFloat('x') AS c, substring('abc', 5) AS d, left('abc', 9) AS e, size(null) AS f, [1, 2] AS g") == [(None, 12, None, "", "abc", 0, [1, 2])]
    assert rows(graph, "MATCH (a)-[r:CALLS*1..2]->(b) WHERE a.name = 'RefreshAll' RETURN id(r) ORDER BY id(r)") == [(10,), (13,)]
    assert cypher(graph, "MATCH (f:File) RETURN *").columns == ["f.name", "f.qualified_name", "f.label", "f.file_path"]
    assert cypher(graph, "MATCH (f:File)").columns == ["f.name", "f.qualified_name", "f.label"]
    assert cypher(graph, "MATCH (f) RETURN f.name, toLower(f.name), 1 = 1, f").columns == ["f.name", "tolower", "column_3", "f"]


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) RETURN foo(n)", "MATCH (n", "MATCH (n) RETURN n UNION MATCH (n) RETURN n.name", "MATCH (n) WHERE n.x IN 3 RETURN n", "UNWIND 3 AS x RETURN x", "MATCH (a)<-[]->(b) RETURN a", "RETURN $nope", "MATCH (n) RETURN n LIMIT x", "MATCH (n) RETURN size(count(n))"])
def test_refused(graph, text):
    with pytest.raises(CypherError):
        cypher(graph, text)


def test_precedence():
    where = parse("MATCH (n) WHERE NOT n.a = 1 AND n.b OR n.c XOR n.d RETURN n")[0][1].where
    assert where[0] == "or" and where[1][0] == "and" and where[1][1][0] == "not" and where[2][0] == "xor"
    assert parse("RETURN `n` AS x")[0][1].result.items[0][0] == ("lit", "n")


def test_an_answer_tells_how_many_there_are(spark, graph):
    from marlstone.plans.cypher import answer

    whole = answer(graph, "MATCH (n) RETURN n.name AS name")
    cut = answer(graph, "MATCH (n) RETURN n.name AS name", most=1)
    assert not whole.truncated and whole.total == whole.rows.count() == cut.total > 1 and cut.truncated and cut.rows.count() == 1
