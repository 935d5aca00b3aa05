"""A property graph over the star schema: regions, nations, customers, suppliers, orders and parts.

A node's id is its key plus ten thousand million times the place of its label; its qualified name goes from the
region down; what else its row holds is in ``properties``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.cypher import Graph
from marlstone.sources.tables import table

LABELS = ("Region", "Nation", "Customer", "Supplier", "Order", "Part")
BASE = 10_000_000_000


def node_id(label: str, key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("bigint") + F.lit(LABELS.index(label) * BASE)


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, project, label, name, qualified_name, file_path, start_line, end_line, properties)``."""
    t = lambda n: table(spark, folder, n)
    region, nation = t("region"), t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.concat_ws(".", "r_name", "n_name")

    def rows(df: DataFrame, label: str, key: str, name: Column, qualified: Column, path: Column, **props) -> DataFrame:
        bag = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in props.items()])) if props else F.lit("{}")
        return df.select(node_id(label, key).alias("id"), F.lit("shop").alias("project"), F.lit(label).alias("label"), name.alias("name"), qualified.alias("qualified_name"), path.alias("file_path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), bag.alias("properties"))

    area = F.concat_ws("/", "r_name", "n_name")
    out = rows(region, "Region", "r_regionkey", F.col("r_name"), F.col("r_name"), F.col("r_name"))
    out = out.unionByName(rows(nation, "Nation", "n_nationkey", F.col("n_name"), place, area))
    customers = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.unionByName(rows(customers, "Customer", "c_custkey", F.col("c_name"), F.concat_ws(".", place, "c_name"), F.concat_ws("/", area, "c_mktsegment"), acctbal="c_acctbal", segment="c_mktsegment"))
    suppliers = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    out = out.unionByName(rows(suppliers, "Supplier", "s_suppkey", F.col("s_name"), F.concat_ws(".", place, "s_name"), area, acctbal="s_acctbal"))
    number = F.concat(F.lit("order."), F.col("o_orderkey").cast("string"))
    out = out.unionByName(rows(t("orders"), "Order", "o_orderkey", number, number, F.lit("orders"), status="o_orderstatus", price="o_totalprice", priority="o_orderpriority"))
    part = F.concat(F.lit("part."), F.col("p_partkey").cast("string"))
    return out.unionByName(rows(t("part"), "Part", "p_partkey", F.col("p_name"), part, F.concat_ws("/", F.lit("parts"), "p_brand"), brand="p_brand", size="p_size", price="p_retailprice"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, project, source_id, target_id, type, properties)``, one per source, target and type."""
    t = lambda n: table(spark, folder, n)

    def rows(df: DataFrame, kind: str, source: Column, target: Column, props: Column | None = None) -> DataFrame:
        return df.select(F.xxhash64(F.lit(kind), source, target).alias("id"), F.lit("shop").alias("project"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), (props if props is not None else F.lit("{}")).alias("properties"))

    out = rows(t("nation"), "IN_REGION", node_id("Nation", "n_nationkey"), node_id("Region", "n_regionkey"))
    out = out.unionByName(rows(t("customer"), "IN_NATION", node_id("Customer", "c_custkey"), node_id("Nation", "c_nationkey")))
    out = out.unionByName(rows(t("supplier"), "IN_NATION", node_id("Supplier", "s_suppkey"), node_id("Nation", "s_nationkey")))
    out = out.unionByName(rows(t("orders"), "PLACED", node_id("Customer", "o_custkey"), node_id("Order", "o_orderkey")))
    lines = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    out = out.unionByName(rows(lines, "CONTAINS", node_id("Order", "l_orderkey"), node_id("Part", "l_partkey"), F.to_json(F.struct("quantity"))))
    offers = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("lines"))
    return out.unionByName(rows(offers, "SUPPLIES", node_id("Supplier", "l_suppkey"), node_id("Part", "l_partkey"), F.to_json(F.struct("lines"))))


def graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(nodes(spark, folder), edges(spark, folder))


def calls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A call graph: part k calls parts (7 k + 3) mod n and, if k is even, k / 2; nodes are functions of a package.

    n is the number of parts, so the graph has chains, hubs and cycles at every scale.
    """
    parts = table(spark, folder, "part")
    n = F.lit(parts.count())
    functions = parts.select(
        F.col("p_partkey").alias("id"), F.lit("calls").alias("project"), F.when(F.col("p_size") % 5 == 0, "Method").otherwise("Function").alias("label"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("app."), F.translate("p_brand", "#", "_"), F.lit("."), F.col("p_type"), F.lit(".part_"), F.col("p_partkey").cast("string")).alias("qualified_name"),
        F.concat(F.lit("src/"), F.translate("p_brand", "#", "_"), F.lit("/"), F.col("p_type"), F.when(F.col("p_size") % 7 == 0, "_test.go").otherwise(".go")).alias("file_path"), F.to_json(F.struct(F.col("p_size").alias("size"), (F.col("p_size") == 1).alias("is_entry_point"))).alias("properties"),
    )
    one = parts.select(F.col("p_partkey").alias("source_id"), ((F.col("p_partkey") * 7 + 3) % n + 1).alias("target_id"))
    two = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") / 2).cast("bigint").alias("target_id"))
    both = one.unionByName(two).distinct()
    return functions, both.select(F.xxhash64("source_id", "target_id").alias("id"), F.lit("calls").alias("project"), "source_id", "target_id", F.lit("CALLS").alias("type"), F.lit("{}").alias("properties"))
