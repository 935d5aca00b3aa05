"""Cypher queries over the commerce graph, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.plans.cypher import cypher
from marlstone.sources import commerce

_B = commerce.BASE
_C, _N, _S, _O, _P = (commerce.LABELS.index(x) * _B for x in ("Customer", "Nation", "Supplier", "Order", "Part"))

#: Name to (Cypher, SQL).
CASES: dict[str, tuple[str, str]] = {
    "c05_match_node": ("MATCH (n:nation|Region) RETURN n.name AS name, n.label AS label", "SELECT n_name AS name, 'Nation' AS label FROM nation UNION ALL SELECT r_name, 'Region' FROM region"),
    "c05_match_props": ("MATCH (c:Customer {segment: 'BUILDING'}) RETURN c.name AS name, toFloat(c.acctbal) AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "c06_multi_pattern": (
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "c07_one_hop": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.status = 'F' RETURN c.name AS name, count(o) AS n ORDER BY n DESC, name LIMIT 10",
        "SELECT c_name AS name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY n DESC, name LIMIT 10",
    ),
    "c07_incoming": ("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "c07_rel_props": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity > 90 RETURN id(o) AS o, id(p) AS p, toFloat(r.quantity) AS q", f"SELECT l_orderkey + {_O} AS o, l_partkey + {_P} AS p, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_partkey HAVING sum(l_quantity) > 90"),
    "c08_undirected": (
        "MATCH (n:Nation)-[:IN_NATION|IN_REGION]-(x) RETURN n.name AS nation, x.label AS label, count(*) AS n",
        "SELECT n_name AS nation, label, count(*) AS n FROM nation JOIN (SELECT 'Customer' AS label, c_nationkey AS k FROM customer UNION ALL SELECT 'Supplier', s_nationkey FROM supplier UNION ALL SELECT 'Region', n_nationkey FROM nation) ON k = n_nationkey GROUP BY 1, 2",
    ),
    "c09_var_length": (
        "MATCH (c:Customer)-[:IN_NATION|IN_REGION*1..2]->(x) RETURN x.label AS label, x.name AS name, count(*) AS n",
        "SELECT 'Nation' AS label, n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT 'Region', r_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "c09_trail": (
        "MATCH (s:Supplier)-[:IN_NATION*2..2]-(x) RETURN s.name AS supplier, x.label AS label, count(x) AS n",
        "SELECT s_name AS supplier, x.label, count(*) AS n FROM supplier s JOIN (SELECT s_name AS name, 'Supplier' AS label, s_nationkey AS k FROM supplier UNION ALL SELECT c_name, 'Customer', c_nationkey FROM customer) x ON x.k = s.s_nationkey AND x.name <> s.s_name GROUP BY 1, 2",
    ),
    "c10_optional": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.name AS name, count(o) AS n",
        "SELECT c_name AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name",
    ),
    "c12_with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n, sum(o.price) AS total WHERE n > 15 RETURN c.name AS name, c.segment AS segment, n, total",
        "SELECT c_name AS name, c_mktsegment AS segment, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment HAVING count(*) > 15",
    ),
    "c16_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.segment AS segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "c17_order_skip_limit": ("MATCH (p:Part) RETURN p.name AS name, p.size AS size, id(p) AS id ORDER BY p.size DESC, id(p) SKIP 5 LIMIT 20", f"SELECT p_name AS name, CAST(p_size AS VARCHAR) AS size, p_partkey + {_P} AS id FROM part ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5"),
    "c19_union": ("MATCH (n:Nation) RETURN n.name AS name UNION MATCH (r:Region) RETURN r.name AS name UNION MATCH (n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region"),
    "c19_union_all": ("MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation UNION ALL SELECT n_name FROM nation"),
    "c21_exists": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order) } RETURN c.name AS name", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "c21_exists_in_case": (
        "MATCH (c:Customer) RETURN CASE WHEN EXISTS { (c)-[:PLACED]->(:Order) } THEN 'buyer' ELSE 'idle' END AS kind, count(*) AS n",
        "SELECT CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'buyer' ELSE 'idle' END AS kind, count(*) AS n FROM customer GROUP BY 1",
    ),
    "c04_unwind": ("UNWIND [3, 1, 2] AS x RETURN x ORDER BY x", "SELECT unnest([1, 2, 3]) AS x"),
    "c30_two_valued": (
        "MATCH (c:Customer) WHERE NOT c.missing = 1 AND c.missing <> 'x' AND c.missing IS NULL RETURN count(*) AS n, count(c.missing) AS none, sum(c.missing) AS zero, avg(c.missing) AS nothing",
        "SELECT count(*) AS n, 0::BIGINT AS none, 0.0::DOUBLE AS zero, NULL::DOUBLE AS nothing FROM customer",
    ),
    "c34_in_list": ("MATCH (p:Part) WHERE p.size IN [1, '7', 50] AND NOT p.brand IN ['Brand#11'] RETURN id(p) AS id", f"SELECT p_partkey + {_P} AS id FROM part WHERE p_size IN (1, 7, 50) AND p_brand <> 'Brand#11'"),
    "c35_text_tests": ("MATCH (c:Customer) WHERE c.name ENDS WITH '7' AND c.name CONTAINS '#' AND c.qualified_name STARTS WITH 'ASIA' RETURN c.name AS name", "SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_name LIKE '%7' AND c_name LIKE '%#%' AND r_name LIKE 'ASIA%'"),
    "c36_regex": ("MATCH (s:Supplier) WHERE s.name =~ '[13579]$' RETURN s.name AS name", "SELECT s_name AS name FROM supplier WHERE regexp_matches(s_name, '[13579]$')"),
    "c38_case": (
        "MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'medium' ELSE 'large' END AS kind, count(*) AS n",
        "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind, count(*) AS n FROM part GROUP BY 1",
    ),
    "c42_text_functions": (
        "MATCH (n:Nation) RETURN toLower(n.name) AS low, size(n.name) AS size, reverse(n.name) AS back, substring(n.name, 1, 3) AS mid, left(n.name, 2) AS l, right(n.name, 2) AS r, replace(n.name, 'A', '_') AS rep, coalesce(n.missing, '', n.label) AS co",
        "SELECT lower(n_name) AS low, length(n_name) AS size, reverse(n_name) AS back, substring(n_name, 2, 3) AS mid, left(n_name, 2) AS l, right(n_name, 2) AS r, replace(n_name, 'A', '_') AS rep, 'Nation' AS co FROM nation",
    ),
    "c50_identity": ("MATCH (n:Nation)-[r:IN_REGION]->(x) RETURN id(n) AS id, type(r) AS kind, labels(n) AS labels, keys(x) AS keys", f"SELECT n_nationkey + {_N} AS id, 'IN_REGION' AS kind, ['Nation'] AS labels, ['file_path', 'label', 'name', 'qualified_name'] AS keys FROM nation"),
    "g02_empty_aggregate": ("MATCH (c:Nothing) RETURN c.name AS name, count(*) AS n, sum(c.acctbal) AS total", "SELECT NULL::VARCHAR AS name, 0::BIGINT AS n, 0.0::DOUBLE AS total"),
    "g03_aggregates": (
        "MATCH (c:Customer) RETURN c.segment AS segment, count(DISTINCT c.acctbal) AS d, avg(c.acctbal) AS mean, min(c.name) AS first, max(c.name) AS last",
        "SELECT c_mktsegment AS segment, count(DISTINCT c_acctbal) AS d, avg(c_acctbal) AS mean, min(c_name) AS first, max(c_name) AS last FROM customer GROUP BY 1",
    ),
}


def _query(text: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return cypher(commerce.graph(spark, folder), text)

    return run


def queries() -> dict:
    return {name: _query(text) for name, (text, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CASES.items()}
