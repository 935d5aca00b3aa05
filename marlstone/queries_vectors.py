"""Queries over the embeddings table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import vectors as v
from marlstone.sources.tables import table

#: Two fixed keyword vectors of 64 places.
KEYWORDS = [[1.0 if (i * 7 + k) % 5 < 2 else -0.5 for i in range(64)] for k in (0, 3)]


def v12_keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    scored = v.keyword_search(table(spark, folder, "embeddings"), "embedding", KEYWORDS)
    return scored.select("vec_id", F.round("score", 5).alias("score"))


def v11_rotated_codes(spark: SparkSession, folder: str) -> DataFrame:
    return v.rotated_codes(table(spark, folder, "embeddings"), "vec_id", "embedding", 64)


def v15_shape_codes(spark: SparkSession, folder: str) -> DataFrame:
    return v.shape_codes(table(spark, folder, "embeddings"), "vec_id", "embedding", 64)


def v13_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return v.hashed_embedding(table(spark, folder, "memory_episodes").dropDuplicates(["id"]), "id", "title")


def v10_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Each file against the first of its project."""
    rows = table(spark, folder, "file_hashes").select("project", "rel_path").distinct()
    first = rows.groupBy("project").agg(F.min("rel_path").alias("first"))
    return rows.join(first, "project").select("project", "rel_path", F.round(v.path_proximity("first", "rel_path"), 6).alias("proximity"))


def l01_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' nations and suppliers' nations that trade, by orders."""
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    trade = lines.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return v.communities(trade.groupBy(F.col("c_nationkey").cast("bigint").alias("a"), F.col("s_nationkey").cast("bigint").alias("b")).agg(F.count("*").cast("double").alias("w")))


def queries() -> dict:
    return {q.__name__: q for q in (v10_proximity, v11_rotated_codes, v12_keyword_search, v13_embedding, v15_shape_codes, l01_communities)}


def oracle_sql() -> dict[str, str]:
    score = ", ".join(f"list_cosine_similarity(embedding::DOUBLE[], {k}::DOUBLE[])" for k in KEYWORDS)
    return {
        "v12_keyword_search": f"SELECT vec_id, round(least({score}), 5) AS score FROM embeddings",
        "v10_proximity": """WITH r AS (SELECT DISTINCT project, rel_path FROM file_hashes), f AS (SELECT project, min(rel_path) AS first FROM r GROUP BY 1),
d AS (SELECT project, rel_path, string_split(first, '/')[:-2] AS a, string_split(rel_path, '/')[:-2] AS b FROM r JOIN f USING (project)),
s AS (SELECT *, list_reduce(list_prepend(0, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: CASE WHEN a[:i] = b[:i] THEN 1 ELSE 0 END)), lambda x, y: x + y) AS n FROM d)
SELECT project, rel_path, round(1 + 0.1 * coalesce(n / nullif(greatest(len(a), len(b)), 0), 0), 6) AS proximity FROM s""",
    }
