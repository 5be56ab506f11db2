"""The driver's tables as a property graph: every business entity is a node, every reference an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph import union_nodes
from loomgraph.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


NODE_TABLES = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name"), "orders": ("o_orderkey", "o_orderpriority")}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(_id(t, k).alias("id"), F.lit(t).alias("kind"), F.col(n).alias("name"), F.concat(F.lit(f"{t}/"), F.col(n)).alias("path"), F.col(k).cast("long").alias("line")) for t, (k, n) in NODE_TABLES.items()]
    return union_nodes(*parts)


def defines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container edges: region over nation, nation over customer and supplier."""
    pairs = [("region", "n_regionkey", "nation", "n_nationkey"), ("nation", "c_nationkey", "customer", "c_custkey"), ("nation", "s_nationkey", "supplier", "s_suppkey")]
    return union_nodes(*[table(spark, sf_dir, child).select(_id(parent, fk).alias("from_id"), _id(child, key).alias("to_id"), F.lit("DEFINES").alias("type"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("resolution")) for parent, fk, child, key in pairs])


def _resolution(flag):
    return F.when(flag == "A", "exact").when(flag == "N", "import_resolved").otherwise("name_only")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLACED, CONTAINS and SUPPLIED_BY, each (from, to) once."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    band = F.when(F.col("o_orderpriority") == "1-URGENT", 0.95).when(F.col("o_orderpriority") == "2-HIGH", 0.8).when(F.col("o_orderpriority") == "3-MEDIUM", 0.5).otherwise(0.3)
    placed = o.select(_id("customer", "o_custkey").alias("from_id"), _id("orders", "o_orderkey").alias("to_id"), F.lit("PLACED").alias("type"), band.alias("confidence"), F.lit("exact").alias("resolution"))
    once = lambda a, b, name: spread(l.select(a, b, "l_discount", "l_returnflag"), a, b).groupBy(a, b).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.min("l_returnflag").alias("flag")).select(
        _id({"l_orderkey": "orders", "l_partkey": "part"}[a], a).alias("from_id"), _id({"l_partkey": "part", "l_suppkey": "supplier"}[b], b).alias("to_id"), F.lit(name).alias("type"), "confidence", _resolution(F.col("flag")).alias("resolution")
    )
    return union_nodes(placed, once("l_orderkey", "l_partkey", "CONTAINS"), once("l_partkey", "l_suppkey", "SUPPLIED_BY"))
