"""The commerce tables as a graph: customers, orders, parts and suppliers with what connects them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.graph import Graph


#: Tables that the graph comes from.
TABLES = ("customer", "orders", "part", "supplier", "lineitem")


def _ranked(df: DataFrame, column: str) -> DataFrame:
    """column and its dense rank, from its distinct values (a handful)."""
    return df.select(column).distinct().withColumn("rank", F.dense_rank().over(W.orderBy(column)))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customer, part = read("customer"), read("part")
    rows = [
        customer.join(_ranked(customer, "c_mktsegment"), "c_mktsegment").select((F.lit(1_000_000_000) + F.col("c_custkey")).alias("id"), (100 + F.col("rank")).alias("label")),
        read("orders").select((F.lit(2_000_000_000) + F.col("o_orderkey")).alias("id"), (200 + F.substring("o_orderpriority", 1, 1).cast("int")).alias("label")),
        part.join(_ranked(part, "p_type"), "p_type").select((F.lit(3_000_000_000) + F.col("p_partkey")).alias("id"), (300 + F.col("rank")).alias("label")),
        read("supplier").select((F.lit(4_000_000_000) + F.col("s_suppkey")).alias("id"), F.lit(400).alias("label")),
    ]
    out = [r.select(F.col("id").cast("long"), F.col("label").cast("double")) for r in rows]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def edges(spark: SparkSession, sf_dir: str, forest: bool = False) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    order, part, supplier = 2_000_000_000 + F.col("l_orderkey"), 3_000_000_000 + F.col("l_partkey"), 4_000_000_000 + F.col("l_suppkey")
    row = lambda df, a, b, x: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), F.lit(float(x)).alias("label"))
    out = row(read("orders"), 1_000_000_000 + F.col("o_custkey"), 2_000_000_000 + F.col("o_orderkey"), 1)
    if forest:
        return out
    lines = read("lineitem")
    return out.unionByName(row(lines, order, part, 2)).unionByName(row(lines, order, supplier, 3)).unionByName(row(lines, part, supplier, 4))


def commerce(spark: SparkSession, sf_dir: str, kinds: Iterable[tuple[float, float, float]] | None = None) -> Graph:
    """kinds: as in Graph.clean()."""
    return Graph.clean(vertices(spark, sf_dir), edges(spark, sf_dir), kinds=kinds)


def forest(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and orders only: each order hangs on one customer."""
    v = vertices(spark, sf_dir).where("label < 300")
    return Graph.clean(v, edges(spark, sf_dir, forest=True))
