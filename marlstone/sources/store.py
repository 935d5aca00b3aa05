"""Keeping a graph: upserts, trace ingestion, listings, copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_KEY = ("project", "qualified_name")
EDGE_KEY = ("project", "source_id", "target_id", "type", "local_name")


def upserted(old: DataFrame, new: DataFrame, key: tuple[str, ...], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key; of several new rows of a key the last by ``order``.

    Null keys equal each other. One shuffle on the key: a row carries whether it is new, and the greatest wins.
    """
    rest = [c for c in old.columns if c not in key]
    tag = lambda df, n, by: df.select(*key, F.struct(F.lit(n).alias("_new"), (F.col(by) if by else F.lit(0)).cast("string").alias("_by"), *rest).alias("_r"))
    both = tag(old, 0, None).unionByName(tag(new.select(*old.columns), 1, order))
    return both.groupBy(*key).agg(F.max("_r").alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*old.columns)


def ingested_traces(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, counts)`` of reported calls ``(source, target, type)``: those with both ends, of type CALLS unless they say
    otherwise, and how many were ``accepted`` and ``rejected``."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    good = filled("source") & filled("target")
    edges = traces.where(good).select("source", "target", F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("CALLS")).alias("type"))
    return edges, traces.agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))


def projects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(project, nodes, edges, files)`` of the projects, shadow graphs left out."""
    n = nodes.groupBy("project").agg(F.count("*").alias("nodes"), F.count_distinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("files"))
    e = edges.groupBy("project").agg(F.count("*").alias("edges"))
    return n.join(e, "project", "left").where(~F.endswith("project", F.lit("::missed"))).select("project", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "files")


def without_project(df: DataFrame, project: str) -> DataFrame:
    """A table less a project and its shadow graph."""
    return df.where(~F.col("project").isin(project, f"{project}::missed"))


def copied(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` and those rows of ``source`` whose key it lacks, over the columns both have."""
    shared = [c for c in target.columns if c in source.columns]
    fresh = source.select(*shared).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)
