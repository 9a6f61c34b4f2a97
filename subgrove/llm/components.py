"""Connected components of a distributed graph, and tables that outlive an executor."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets one below its warehouse; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared").rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables in the shared folder that are of no use once a result has been written; done() writes it and removes them."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.at: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        """The rows of df, written to the shared folder and read back: computed once, and not lost with an executor."""
        spark, schema = df.sparkSession, df.schema
        path = f"{shared_folder(spark)}/subgrove-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        out = spark.read.schema(schema).parquet(path)
        self.at[id(out)] = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Removes a table that this made."""
        path = self.at[id(table)]
        self.paths.remove(path)
        _remove(table.sparkSession, path)

    def less(self, spark: SparkSession, keep: int = 0) -> None:
        """Removes all but the last so many."""
        gone, self.paths = (self.paths[:-keep], self.paths[-keep:]) if keep else (self.paths, [])
        for path in gone:
            _remove(spark, path)

    def done(self, df: DataFrame) -> DataFrame:
        out = stored(df)
        self.less(df.sparkSession)
        return out


def sweep(spark: SparkSession) -> None:
    """Lets executors delete the shuffle files of what has been written and is referred to no more: Spark learns of that only when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from a table of their own, which stays."""
    return Scratch()(df)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is linked with, itself included) of each node in edges (a, b).

    Alternating large and small stars: each round links a node's neighbours to the least of them, so links
    only ever grow fewer or shorter; the number of rounds is logarithmic in the longest path. A node's
    neighbours are aggregated to a minimum before they are joined back, never gathered in one task.
    """
    spark, scratch = edges.sparkSession, Scratch()
    links = scratch(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = scratch(small.where("a <> b").distinct())
        scratch.less(spark, keep=1)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
