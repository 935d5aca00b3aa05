"""Traversals, searches and roll-ups over the commerce and call graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import graph as g
from marlstone.sources import commerce
from marlstone.sources.tables import table

_B = commerce.BASE


def _calls(run):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return run(*commerce.calls(spark, folder))

    return query


def _shop(run):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return run(commerce.nodes(spark, folder), commerce.edges(spark, folder))

    return query


def _change_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What the ledger's first run took in, against the files of today."""
    first = table(spark, folder, "ledger_files").where("run_id = 1").select("project", "rel_path", "sha256").distinct()
    return g.change_plan(first, table(spark, folder, "file_hashes").select("project", "rel_path", "sha256").distinct())


def _co_change(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of few kinds ordered together; commits of more than five files are left out, as orders have few lines."""
    return g.co_change(_commits(spark, folder), most_files=5, score=0.05)


def _commits(spark: SparkSession, folder: str) -> DataFrame:
    """An order is a commit, a brand and size a file."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_orderkey").alias("commit"), F.concat_ws("/", "p_brand", (F.col("p_size") % 2).cast("string")).alias("file"), F.col("l_shipdate").alias("at"))


QUERIES = {
    "q15_degrees": _shop(lambda n, e: g.degrees(e)),
    "t01_neighbours": _calls(lambda n, e: g.neighbours(n, e, F.lit(True))),
    "t02_trace": _calls(lambda n, e: g.trace(n, e, F.col("id") == 1, "out", 6).select("id", "hop")),
    "t03_impact": _calls(lambda n, e: g.impact(n, e, F.col("id") == 3, 4)),
    "t05_schema": _shop(g.schema),
    "t05_properties": _shop(lambda n, e: g.property_names(n)),
    "t07_languages": _calls(lambda n, e: g.languages(n)),
    "t08_packages": _calls(lambda n, e: g.packages(n)),
    "t09_boundaries": _calls(g.boundaries),
    "t10_layers": _calls(g.layers),
    "t11_file_tree": _calls(lambda n, e: g.file_tree(n)),
    "t13_hotspots": _calls(g.hotspots),
    "t14_cycles": _calls(lambda n, e: g.components(e)),
    "q05_structural_search": _calls(lambda n, e: g.structural_search(n, e, name="_1[0-9]*$", labels=["method"], degree=(1, 3))),
    "q08_lookup": _calls(lambda n, e: g.lookup(n, "part_7").select("id", "stage")),
    "q12_expand": _calls(lambda n, e: g.expand(n, e, F.col("id") == 1).select("id", "hop", "degree")),
    "q14_rendered": _calls(lambda n, e: g.rendered(n, g.expand(n, e, F.col("id") == 1, 6), budget=500)),
    "q01_search": _calls(lambda n, e: g.search(n, e, labels=["method"], degree=(3, 4), limit=500)),
    "p01_change_plan": _change_plan,
    "p02_co_change": _co_change,
    "p03_file_history": lambda spark, folder: g.file_history(_commits(spark, folder)),
    "p04_tests": _calls(g.tests_edges),
}


def queries() -> dict:
    return QUERIES


_CALLS = """WITH RECURSIVE k AS (SELECT count(*) AS n FROM part), e AS (
  SELECT DISTINCT s, t FROM (SELECT p_partkey AS s, (p_partkey * 7 + 3) % n + 1 AS t FROM part, k UNION ALL SELECT p_partkey, CAST(p_partkey / 2 AS BIGINT) FROM part WHERE p_partkey % 2 = 0)),
f AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'Method' ELSE 'Function' END AS label, 'part_' || p_partkey AS name, 'app.' || replace(p_brand, '#', '_') || '.' || p_type || '.part_' || p_partkey AS qn, replace(p_brand, '#', '_') AS brand, p_type AS pkg,
  'src/' || replace(p_brand, '#', '_') || '/' || p_type || CASE WHEN p_size % 7 = 0 THEN '_test.go' ELSE '.go' END AS path, p_size = 1 AS entry FROM part)"""
_BOUND = "b AS (SELECT x.pkg AS source, y.pkg AS target, count(*) AS calls FROM e JOIN f x ON s = x.id JOIN f y ON t = y.id WHERE x.pkg <> y.pkg GROUP BY ALL ORDER BY calls DESC, source, target LIMIT 20)"


def oracle_sql() -> dict[str, str]:
    c, n, s, o, p = (commerce.LABELS.index(x) * _B for x in ("Customer", "Nation", "Supplier", "Order", "Part"))
    shop = f"""WITH x AS (SELECT n_nationkey + {n} AS s, n_regionkey AS t, 'IN_REGION' AS k, 'Nation' AS a, 'Region' AS b FROM nation UNION ALL SELECT c_custkey + {c}, c_nationkey + {n}, 'IN_NATION', 'Customer', 'Nation' FROM customer
UNION ALL SELECT s_suppkey + {s}, s_nationkey + {n}, 'IN_NATION', 'Supplier', 'Nation' FROM supplier UNION ALL SELECT o_custkey + {c}, o_orderkey + {o}, 'PLACED', 'Customer', 'Order' FROM orders
UNION ALL SELECT DISTINCT l_orderkey + {o}, l_partkey + {p}, 'CONTAINS', 'Order', 'Part' FROM lineitem UNION ALL SELECT DISTINCT l_suppkey + {s}, l_partkey + {p}, 'SUPPLIES', 'Supplier', 'Part' FROM lineitem)"""
    labels = " UNION ALL ".join(f"SELECT 'label', '{x}', count(*) FROM {t}" for x, t in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Order", "orders"), ("Part", "part")))
    props = {"Customer": ("customer", "acctbal segment"), "Supplier": ("supplier", "acctbal"), "Order": ("orders", "status price priority"), "Part": ("part", "brand size price")}
    return {
        "q15_degrees": shop + " SELECT id, sum(o) AS out_degree, sum(i) AS in_degree, count(*) AS degree FROM (SELECT s AS id, 1 AS o, 0 AS i FROM x UNION ALL SELECT t, 0, 1 FROM x) GROUP BY id",
        "t01_neighbours": _CALLS + " SELECT s AS id, 'out' AS direction, 'CALLS' AS type, t AS neighbour_id, qn AS neighbour FROM e JOIN f ON t = f.id UNION ALL SELECT t, 'in', 'CALLS', s, qn FROM e JOIN f ON s = f.id WHERE t IN (SELECT id FROM f)",
        "t02_trace": _CALLS + ", r AS (SELECT 1::BIGINT AS id, 0 AS hop UNION SELECT t, hop + 1 FROM r JOIN e ON s = r.id WHERE hop < 6) SELECT id, min(hop) AS hop FROM r GROUP BY id",
        "t03_impact": _CALLS + ", r AS (SELECT 3::BIGINT AS id, 0 AS hop UNION SELECT s, hop + 1 FROM r JOIN e ON t = r.id WHERE hop < 4), m AS (SELECT id, min(hop) AS hop FROM r GROUP BY id) SELECT 'src/' || brand AS module, count(*) AS affected, min(hop) AS nearest FROM m JOIN f USING (id) WHERE hop > 0 GROUP BY 1",
        "t05_schema": shop + " SELECT 'type' AS kind, k AS name, count(*) AS n FROM x GROUP BY k UNION ALL SELECT 'pattern', '(' || a || ')-[' || k || ']->(' || b || ')', count(*) FROM x GROUP BY a, k, b UNION ALL " + labels,
        "t05_properties": " UNION ALL ".join(f"SELECT '{x}' AS label, '{q}' AS property, count(*) AS n FROM {t}" for x, (t, qs) in props.items() for q in qs.split()),
        "t07_languages": _CALLS + " SELECT 'go' AS language, count(DISTINCT path) AS files FROM f",
        "t08_packages": _CALLS + " SELECT pkg AS package, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, package LIMIT 15",
        "t09_boundaries": _CALLS + ", " + _BOUND + " SELECT * FROM b",
        "t10_layers": _CALLS + ", " + _BOUND + """, w AS (SELECT source AS package, 0 AS i, calls AS o, false AS entry FROM b UNION ALL SELECT target, calls, 0, false FROM b UNION ALL SELECT pkg, 0, 0, true FROM f WHERE entry),
v AS (SELECT package, sum(i) AS fan_in, sum(o) AS fan_out, bool_or(entry) AS entry FROM w GROUP BY 1)
SELECT package, fan_in, fan_out, CASE WHEN entry AND fan_out > 0 AND fan_in = 0 THEN 'entry' WHEN fan_in > fan_out AND fan_in > 3 THEN 'core' WHEN fan_out = 0 AND fan_in > 0 THEN 'leaf' WHEN fan_in = 0 AND fan_out > 0 THEN 'entry' ELSE 'internal' END AS layer FROM v""",
        "t11_file_tree": _CALLS + ", d AS (SELECT DISTINCT path, brand, split_part(path, '/', 3) AS file FROM f) SELECT 'src' AS path, 'dir' AS kind, count(DISTINCT brand) AS children FROM d UNION ALL SELECT 'src/' || brand, 'dir', count(DISTINCT file) FROM d GROUP BY brand UNION ALL SELECT path, 'file', 0 FROM d",
        "t13_hotspots": _CALLS + " SELECT qn AS qualified_name, count(*) AS fan_in FROM e JOIN f ON t = f.id WHERE path NOT LIKE '%test%' GROUP BY qn ORDER BY fan_in DESC, qn LIMIT 10",
        "q05_structural_search": _CALLS + ", d AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM e UNION ALL SELECT t FROM e) GROUP BY 1) SELECT f.id, qn AS qualified_name, label, 10000 + coalesce(degree, 0) AS score FROM f LEFT JOIN d USING (id) WHERE regexp_matches(name, '_1[0-9]*$') AND label = 'Method' AND coalesce(degree, 0) BETWEEN 1 AND 3",
        "q08_lookup": "SELECT 7::BIGINT AS id, 2 AS stage FROM part WHERE p_partkey = 7",
        "q12_expand": _CALLS + ", u AS (SELECT s AS a, t AS b FROM e UNION ALL SELECT t, s FROM e), r AS (SELECT 1::BIGINT AS id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN u ON a = r.id WHERE hop < 2), d AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY 1) SELECT id, min(hop) AS hop, any_value(degree) AS degree FROM r JOIN d USING (id) GROUP BY id",
        "p01_change_plan": """WITH a AS (SELECT DISTINCT project, rel_path, sha256 AS o FROM ledger_files WHERE run_id = 1), b AS (SELECT DISTINCT project, rel_path, sha256 AS n FROM file_hashes),
d AS (SELECT project, rel_path, o, n, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' ELSE 'modified' END AS change, coalesce(n, o) AS h FROM a FULL JOIN b USING (project, rel_path) WHERE o IS DISTINCT FROM n),
m AS (SELECT project, h, max(rel_path) FILTER (change = 'added') AS rel_path, max(rel_path) FILTER (change = 'deleted') AS old_path FROM d WHERE change <> 'modified' GROUP BY 1, 2 HAVING count(*) FILTER (change = 'added') = 1 AND count(*) FILTER (change = 'deleted') = 1)
SELECT project, rel_path, 'renamed' AS change, old_path FROM m UNION ALL SELECT project, rel_path, change, NULL FROM d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.project = d.project AND d.rel_path IN (m.rel_path, m.old_path) AND change <> 'modified')""",
        "p02_co_change": """WITH r AS (SELECT l_orderkey AS c, p_brand || '/' || (p_size % 2) AS f, max(l_shipdate) AS at FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
k AS (SELECT * FROM r WHERE c IN (SELECT c FROM r GROUP BY c HAVING count(*) <= 5)), t AS (SELECT f, count(*) AS n FROM k GROUP BY f),
p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS together, max(a.at) AS last FROM k a JOIN k b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT file_a, file_b, together, together / least(x.n, y.n) AS score, last FROM p JOIN t x ON file_a = x.f JOIN t y ON file_b = y.f WHERE together / least(x.n, y.n) >= 0.05""",
        "q14_rendered": _CALLS + r""", u AS (SELECT s AS a, t AS b FROM e UNION ALL SELECT t, s FROM e), r AS (SELECT 1::BIGINT AS id, 0 AS hop UNION SELECT b, hop + 1 FROM r JOIN u ON a = r.id WHERE hop < 6), h AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1), d AS (SELECT a AS id, count(*) AS degree FROM u GROUP BY 1),
l AS (SELECT hop, degree, qn, 'NODE ' || name || ' [qn=' || qn || ' src=' || path || ' loc=- community=' || regexp_replace(qn, '\.[^.]*$', '') || ']' AS line FROM h JOIN f USING (id) JOIN d USING (id))
SELECT row_number() OVER o AS place, line, sum(strlen(line) + 1) OVER o <= 1500 OR hop = 0 AS shown FROM l WINDOW o AS (ORDER BY hop, degree DESC, qn ROWS UNBOUNDED PRECEDING)""".replace("\\\\", "\\"),
        "q01_search": _CALLS + ", d AS (SELECT id, count(*) AS degree FROM (SELECT s AS id FROM e UNION ALL SELECT t FROM e) GROUP BY 1) SELECT f.id, qn AS qualified_name, 'structure' AS way, (10000 + degree)::DOUBLE AS score FROM f JOIN d USING (id) WHERE label = 'Method' AND degree BETWEEN 3 AND 4 ORDER BY degree DESC, qn, id LIMIT 500",
        "p03_file_history": "SELECT p_brand || '/' || (p_size % 2) AS file, count(DISTINCT l_orderkey) AS changes, max(l_shipdate) AS last FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
        "p04_tests": _CALLS + " SELECT s AS source_id, t AS target_id FROM e JOIN f x ON s = x.id JOIN f y ON t = y.id WHERE x.path LIKE '%_test.go' AND y.path NOT LIKE '%_test.go'",
    }
