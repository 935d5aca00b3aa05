"""Queries of the general operators, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import hierarchy, incremental
from marlstone.session import shared_folder
from marlstone.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records the next run must take: the difference between the version the last successful run left and the
    present tables, which are adopted as the newest version."""
    runs = table(spark, folder, "run_log")
    at = incremental.instant(F.col("updated_at"))

    def due(name: str, keys: list[str], ledger: DataFrame, values: list[str], column: str, changed) -> DataFrame:
        versions = incremental.VersionedTable(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", keys)
        done = versions.take_runs(ledger, runs, values)
        now = versions.adopt(f"{folder}/{name}.parquet", [*keys, column])
        return versions.delta(done, now, changed)[0].select(*keys).distinct()

    files = due("file_hashes", ["project", "rel_path"], table(spark, folder, "ledger_files"), ["sha256"], "sha256", ~F.col("now.sha256").eqNullSafe(F.col("live.sha256")))
    episodes = due("memory_episodes", ["uid"], table(spark, folder, "ledger_episodes").withColumn("at", at), ["at"], "updated_at", F.col("live.at") < incremental.instant(F.col("now.updated_at")))
    return files.select(F.lit("file_hashes").alias("src"), F.col("project").alias("rec_group"), F.col("rel_path").alias("rec_key")).unionByName(
        episodes.select(F.lit("memory_episodes").alias("src"), F.lit("").alias("rec_group"), F.col("uid").alias("rec_key"))
    )


def _forest(spark: SparkSession, folder: str) -> DataFrame:
    """Both trees as one forest; the tree's name before the id keeps them apart."""
    spans = hierarchy.parent_links(table(spark, folder, "spans"), "span_id", "parent_span_id", ["end_time_unix_nano"])
    metas = hierarchy.parent_links(table(spark, folder, "session_meta"), "id", "parent_id", ["started_at"])
    named = [df.select(F.concat(F.lit(f"{name}/"), "id").alias("id"), F.concat(F.lit(f"{name}/"), "parent").alias("parent")) for name, df in (("spans", spans), ("session_meta", metas))]
    return named[0].unionByName(named[1])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes whose chain of parents runs into a loop."""
    lost = hierarchy.resolve(_forest(spark, folder)).where("cyclic")
    return lost.select(F.split_part("id", F.lit("/"), F.lit(1)).alias("tree"), F.expr("substring(id, instr(id, '/') + 1)").alias("node_id"))


def p7_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Root, depth and path of every node of both forests."""
    full = hierarchy.resolve(_forest(spark, folder), with_paths=True)
    bare = lambda c: F.expr(f"substring({c}, instr({c}, '/') + 1)")
    path = F.array_join(F.transform("path", lambda x: F.substring_index(x, "/", -1)), ">")
    return full.select(F.split_part("id", F.lit("/"), F.lit(1)).alias("tree"), bare("id").alias("node_id"), bare("root").alias("root"), "depth", path.alias("path"))


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of both forests with each of its descendants and their distance."""
    below = hierarchy.descendants(hierarchy.resolve(_forest(spark, folder), with_paths=True))
    bare = lambda c: F.expr(f"substring({c}, instr({c}, '/') + 1)")
    return below.select(F.split_part("ancestor", F.lit("/"), F.lit(1)).alias("tree"), bare("ancestor").alias("node_id"), bare("descendant").alias("descendant"), "distance")


def queries() -> dict:
    return {"p5_found": p5_found, "p7_found": p7_found, "p7_hierarchy": p7_hierarchy, "p7_descendants": p7_descendants}


_NS = "epoch_us(CAST({0} AS TIMESTAMPTZ))"
_TREES = """
WITH RECURSIVE n AS (
  SELECT 'spans' AS tree, span_id AS id, max(CASE WHEN trim(parent_span_id) = '' OR regexp_full_match(trim(parent_span_id), '0*') THEN NULL ELSE parent_span_id END) AS parent FROM spans WHERE span_id <> '' GROUP BY span_id
  UNION ALL
  SELECT 'session_meta', id, max(CASE WHEN trim(parent_id) = '' OR regexp_full_match(trim(parent_id), '0*') THEN NULL ELSE parent_id END) FROM session_meta WHERE id <> '' GROUP BY id),
r(tree, id, root, depth, path) AS (
  SELECT tree, id, id, 0::BIGINT, id FROM n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM n q WHERE q.tree = n.tree AND q.id = n.parent)
  UNION ALL
  SELECT n.tree, n.id, r.root, r.depth + 1, r.path || '>' || n.id FROM n JOIN r ON n.tree = r.tree AND n.parent = r.id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"""
WITH ok AS (SELECT run_id FROM run_log WHERE status = 'succeeded'),
f AS (SELECT project, rel_path, arg_max(sha256, run_id) AS sha256 FROM ledger_files JOIN ok USING (run_id) GROUP BY ALL),
e AS (SELECT uid, arg_max({_NS.format('updated_at')}, run_id) AS at FROM ledger_episodes JOIN ok USING (run_id) GROUP BY ALL)
SELECT DISTINCT 'file_hashes' AS src, c.project AS rec_group, c.rel_path AS rec_key FROM file_hashes c LEFT JOIN f ON c.project = f.project AND c.rel_path = f.rel_path
WHERE f.rel_path IS NULL OR f.sha256 IS DISTINCT FROM c.sha256
UNION ALL
SELECT DISTINCT 'memory_episodes', '', c.uid FROM memory_episodes c LEFT JOIN e ON c.uid = e.uid WHERE e.uid IS NULL OR e.at < {_NS.format('c.updated_at')}""",
        "p7_found": _TREES + "SELECT n.tree, n.id AS node_id FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tree = n.tree AND r.id = n.id)",
        "p7_descendants": _TREES.rstrip() + """,
d(tree, node_id, descendant, distance) AS (
  SELECT n.tree, n.parent, n.id, 1::BIGINT FROM n JOIN r p ON p.tree = n.tree AND p.id = n.parent
  UNION ALL
  SELECT n.tree, n.parent, d.descendant, d.distance + 1 FROM d JOIN n ON n.tree = d.tree AND n.id = d.node_id JOIN r p ON p.tree = n.tree AND p.id = n.parent)
SELECT * FROM d""",
        "p7_hierarchy": _TREES + "SELECT n.tree, n.id AS node_id, r.root, r.depth, r.path FROM n LEFT JOIN r ON r.tree = n.tree AND r.id = n.id",
    }
