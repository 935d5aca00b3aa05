"""Queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import conversations, handwritten, mixing, packing, pii, quality, vector_neighbours
from marlstone.llm import near_duplicates as nd
from marlstone.llm.tokens import token_counts
from marlstone.sources.tables import table


MAX_SKEW = 30.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions to drop: broken ones, and as TESTDATA.md orders by ``sent_at``, those that are whole only by corrected clocks."""
    sessions = conversations.rebuild(table(spark, folder, "payload"), MAX_SKEW, ("user", "assistant")).sessions
    return sessions.where("not ok or user_offset <> 0 or assistant_offset <> 0").select("session_id")


def p1_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered messages of the sessions that are kept, clocks corrected by up to 30 seconds."""
    return conversations.rebuild(table(spark, folder, "payload"), MAX_SKEW).messages


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files that nobody wrote by hand."""
    return handwritten.origins(table(spark, folder, "file_hashes"), table(spark, folder, "known_library_files")).where("origin <> 'handwritten'").select("project", "rel_path")


def p2_origins(spark: SparkSession, folder: str) -> DataFrame:
    """The origin and the family of every file."""
    return handwritten.classified(table(spark, folder, "file_hashes"), table(spark, folder, "known_library_files"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of episodes whose words are the same to 0.6 or more."""
    return nd.all_pairs(nd.near_duplicates(table(spark, folder, "memory_episodes").select("id", "title", "text"), "id", ["title", "text"]))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every episode with its class of equal word sets and the number of links to other classes."""
    return nd.grouped(nd.near_duplicates(table(spark, folder, "memory_episodes").select("id", "title", "text"), "id", ["title", "text"]))


PII_FIELDS = (("memory_episodes", "uid", "text"), ("payload", "message_id", "prompt"), ("codex_tool_record", "tool_use_id", "tool_input"))


SECRET = "fixed for the check"  # a parameter of production


def _personal(spark: SparkSession, folder: str) -> list:
    return [(name, table(spark, folder, name), key, text) for name, key, text in PII_FIELDS]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of personal information replaced in each record."""
    return pii.found_in(_personal(spark, folder), SECRET)


def p4_scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with placeholders."""
    return pii.pseudonymised_in(_personal(spark, folder), SECRET)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a cosine of 0.8 or more, one among the 5 most similar of the other."""
    return vector_neighbours.pairs(vector_neighbours.neighbours(table(spark, folder, "memory_vectors")))


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The up to 5 most similar vectors of every vector."""
    return vector_neighbours.neighbours(table(spark, folder, "memory_vectors"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = packing.kept_sizes(token_counts(table(spark, folder, "documents"), "doc_id", "text"))
    capacities = [(r.capacity_name, r.capacity_tokens) for r in table(spark, folder, "pack_capacities").collect()]  # a few parameters
    return packing.pack(sizes, capacities)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are split at each capacity, from the packing."""
    return _packed(spark, folder).where("pieces > 1").select("capacity_tokens", F.col("id").alias("doc_id")).distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece and its container, for each capacity."""
    return _packed(spark, folder)


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, list]:
    sizes = packing.kept_sizes(token_counts(table(spark, folder, "documents"), "doc_id", "text", extra=("source",)))
    targets = [tuple(r) for r in table(spark, folder, "mix_targets").select("source", "target_share", "max_repeats").collect()]  # a few parameters
    return mixing.mix(sizes, targets), targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in the mixture, with its slot."""
    return _mixed(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares."""
    return mixing.share_report(*_mixed(spark, folder))


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    words = [r.word for r in table(spark, folder, "common_words").select("word").distinct().collect()]  # a fixed list
    return quality.statistics(table(spark, folder, "documents"), "doc_id", "text", words)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of which less than half is natural prose."""
    return _statistics(spark, folder).where("not is_prose").select(F.col("id").alias("doc_id")).distinct()


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics of every document."""
    return _statistics(spark, folder).dropDuplicates(["id"])


def queries() -> dict:
    own = (p1_found, p1_conversations, p2_found, p2_origins, p3_found, p3_groups, p4_found, p4_scrubbed, p6_found, p6_neighbours, p8_found, p8_containers, p9_mix, p9_shares, p10_found, p10_statistics)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
WITH m AS (SELECT message_id, unnest(max_by({'session_id': session_id, 'role': role, 'text': text, 'prompt': prompt, 'generation_id': generation_id, 'sent_at': sent_at, 'received_at': received_at}, received_at)) FROM payload GROUP BY message_id),
s AS (SELECT *, trim(lower(role), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS who, regexp_matches(coalesce(text, ''), '[^\s\p{Z}\p{C}]') AS vt, regexp_matches(coalesce(prompt, ''), '[^\s\p{Z}\p{C}]') AS vp FROM m WHERE trim(session_id) <> ''),
t AS (SELECT *, CASE WHEN who IN ('user', 'human') OR (role IS NULL AND vp) THEN 'u' WHEN who IN ('assistant', 'ai', 'model') THEN 'a' END AS k, vt OR vp AS w FROM s),
u AS (SELECT *, sum(CASE WHEN k = 'u' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, generation_id IS NULL ORDER BY sent_at, received_at, message_id) AS n FROM t WHERE k IS NOT NULL),
g AS (SELECT session_id, coalesce('g' || generation_id, 'n' || n) AS turn, min(CASE WHEN k = 'u' AND w THEN (sent_at, received_at, message_id) END) < max(CASE WHEN k = 'a' AND w THEN (sent_at, received_at, message_id) END) AS whole FROM u GROUP BY ALL)
SELECT s.session_id FROM (SELECT DISTINCT session_id FROM s) s LEFT JOIN g USING (session_id) GROUP BY 1 HAVING count(turn) = 0 OR NOT bool_and(coalesce(whole, false))""",
        "p2_found": "SELECT DISTINCT project, rel_path FROM file_hashes WHERE " + " OR ".join("regexp_matches(rel_path, '" + rule.replace("'", "''") + "')" for rule in handwritten.RULES.values()) + f" OR size > {handwritten.LARGEST} OR sha256 IN (SELECT sha256 FROM known_library_files)",
        "p6_found": """
WITH v AS (SELECT DISTINCT episode_id AS id, embedder_id AS e, vector::DOUBLE[] AS x FROM memory_vectors WHERE embedder_id IS NOT NULL AND len(vector) = dimensions AND list_max(list_transform(vector, lambda y: abs(y))) > 0),
p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.e = b.e AND len(a.x) = len(b.x) AND a.id <> b.id),
k AS (SELECT a, b FROM p WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS episode_a, greatest(a, b) AS episode_b FROM k""",
        "p3_groups": """
WITH e AS (SELECT id, any_value(list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z0-9]+')))) AS w FROM memory_episodes WHERE id IS NOT NULL GROUP BY id),
m AS (SELECT id, w, CASE WHEN len(w) = 0 THEN id ELSE min(id) OVER (PARTITION BY w) END AS class_id FROM e), c AS (SELECT class_id, any_value(w) AS w, count(*) AS copies FROM m GROUP BY 1),
p AS (SELECT a.class_id AS x, b.class_id AS y, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM c a JOIN c b ON a.class_id <> b.class_id AND len(a.w) >= 0.6 * len(b.w) AND len(b.w) >= 0.6 * len(a.w) AND len(a.w) > 0),
l AS (SELECT x, count(*) AS links FROM p WHERE i / (n - i) >= 0.6 GROUP BY 1)
SELECT id, m.class_id, copies, coalesce(links, 0) AS links FROM m JOIN c USING (class_id) LEFT JOIN l ON x = m.class_id""",
        "p3_found": """
WITH e AS (SELECT id, any_value(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z0-9]+'))) AS w FROM memory_episodes GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM e a JOIN e b ON a.id < b.id AND len(a.w) >= 0.6 * len(b.w) AND len(b.w) >= 0.6 * len(a.w) AND len(a.w) > 0)
SELECT id_a, id_b FROM p WHERE i / (n - i) >= 0.6""",
    }
