"""Queries of derivations and of further roll-ups, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import derivations as d
from marlstone.operators import memory as m
from marlstone.operators import sessions as s
from marlstone.queries_records import _E, _SPANS, _at
from marlstone.sources import commerce
from marlstone.sources.tables import table


def p05_config_links(spark: SparkSession, folder: str) -> DataFrame:
    """Names of JSON and YAML files against those of other files."""
    rows = table(spark, folder, "file_hashes").select("rel_path", F.regexp_replace(F.substring_index("rel_path", "/", -1), r"\..*$", "").alias("name"))
    data = F.col("rel_path").rlike(r"\.(json|yaml)$")
    return d.config_links(rows.where(data).select("name").distinct(), rows.where(~data).select("name").distinct())


def p06_resolved_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every edge of the call graph as a call by the callee's bare name from the caller's package."""
    nodes, edges = commerce.calls(spark, folder)
    symbols = nodes.select("id", "qualified_name", "name")
    module = F.regexp_replace("qualified_name", r"\.[^.]*$", "")
    calls = edges.join(symbols.select(F.col("id").alias("source_id"), module.alias("module")), "source_id").join(symbols.select(F.col("id").alias("target_id"), F.col("name").alias("callee")), "target_id")
    imports = spark.createDataFrame([], "module string, alias string, target string")
    return d.resolve_calls(calls.select(F.col("id").alias("call_id"), "module", "callee"), symbols, imports).groupBy("qualified_name", "strategy").agg(F.count("*").alias("calls"), F.max("confidence").alias("confidence"))


def q09_seeds(spark: SparkSession, folder: str) -> DataFrame:
    nodes, _ = commerce.calls(spark, folder)
    return d.seeds(nodes, "what does part_17 call?").select("id")


def e18_replay(spark: SparkSession, folder: str) -> DataFrame:
    return s.replay(s.adopted(s.resolved(table(spark, folder, "spans")))).select("session", "ms", "path", "state", "visit")


def m27_observations(spark: SparkSession, folder: str) -> DataFrame:
    made, _ = m.observations(table(spark, folder, "memory_episodes"))
    return made.select("session_id", "title", "text")


def m29_session_rollups(spark: SparkSession, folder: str) -> DataFrame:
    return m.session_rollups(table(spark, folder, "memory_episodes"))


def v08_similar_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose token triples are nearly the same, whole copies included."""
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return d.similar_code(table(spark, folder, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("string").alias("qualified_name"), tokens.alias("tokens")))


def queries() -> dict:
    return {q.__name__: q for q in (p05_config_links, p06_resolved_calls, q09_seeds, e18_replay, m27_observations, m29_session_rollups, v08_similar_texts)}


def oracle_sql() -> dict[str, str]:
    stem = "regexp_replace(string_split(rel_path, '/')[-1], '\\..*$', '')"
    key = f"lower(trim(regexp_replace(regexp_replace({stem}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_'))"
    return {
        "p05_config_links": f"""WITH r AS (SELECT DISTINCT {stem} AS name, {key} AS n, regexp_matches(rel_path, '\\.(json|yaml)$') AS data FROM file_hashes),
k AS (SELECT * FROM r WHERE data AND len(string_split(n, '_')) >= 2 AND len(list_filter(string_split(n, '_'), lambda w: length(w) < 3)) = 0), c AS (SELECT * FROM r WHERE NOT data AND n <> '')
SELECT k.name AS key, c.name AS symbol, max(CASE WHEN k.n = c.n THEN 0.85 ELSE 0.75 END)::DOUBLE AS confidence FROM k JOIN c ON contains('_' || c.n || '_', '_' || k.n || '_') GROUP BY 1, 2""",
        "q09_seeds": "SELECT p_partkey AS id FROM part WHERE p_partkey = 17",
        "e18_replay": _SPANS + """, f AS (SELECT session, min(start_time_unix_nano) AS t0 FROM r WHERE session IS NOT NULL GROUP BY 1)
SELECT session, (start_time_unix_nano - t0) // 1000000 AS ms, attributes['coding_agent.file_path'] AS path, CASE WHEN name = 'edit' OR coalesce(regexp_matches(attributes['gen_ai.tool.name'], '(?i)write|edit|patch'), false) THEN 'edited' WHEN coalesce(regexp_matches(attributes['gen_ai.tool.name'], '(?i)read'), false) THEN 'read' ELSE 'seen' END AS state,
row_number() OVER (PARTITION BY session, attributes['coding_agent.file_path'] ORDER BY start_time_unix_nano, span_id) AS visit FROM r JOIN f USING (session) WHERE attributes['coding_agent.file_path'] <> ''""",
        "m27_observations": _E + r" SELECT session_id, title, text FROM e WHERE kind = 'prompt' AND trim(text) <> '' AND NOT regexp_matches(trim(text), '(?i)\?\s*$|^\s*(?:who|what|when|where|why|how|which|can|could|should|would|is|are|does|do|did)\b')",
        "m29_session_rollups": _E + f""", w AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY {_at('created_at')}, id) AS n FROM e WHERE session_id <> '' AND kind IN ('prompt', 'observation')),
p AS (SELECT session_id, max_by(coalesce(nullif(left(split_part(trim(text), chr(10), 1), 240), ''), left(split_part(trim(title), chr(10), 1), 80)), n) AS q FROM w WHERE kind = 'prompt' AND n <= 8 GROUP BY 1),
o AS (SELECT session_id, min_by(left(split_part(trim(title || ' ' || text), chr(10), 1), 200), n) AS l FROM w WHERE kind = 'observation' AND n <= 16 AND topic IN ('decision', 'bugfix', 'feature', 'refactor', 'discovery') GROUP BY 1)
SELECT session_id, coalesce(nullif(concat_ws(chr(10), CASE WHEN q <> '' THEN 'request: ' || q END, CASE WHEN l <> '' THEN 'learned: ' || l END), ''), 'request:') AS text FROM p FULL JOIN o USING (session_id)""",
    }
