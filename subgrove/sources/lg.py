"""Graphs in .lg text: a header line, v <id> <label> lines, then e <id> <id> <label> lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph


def _number(part: str, kind: str, line: Column) -> Column:
    value = F.expr(f"try_cast({part} AS {kind})")
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit("malformed .lg line: "), line)).cast(kind)).otherwise(value)


def parse_lg(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label, at) and edges (src, dst, label, at) of rows (value, at). Other lines are skipped; a bad number raises."""
    split = lines.withColumn("p", F.split(F.trim("value"), r"\s+"))
    line = F.col("value")
    v = split.where("p[0] = 'v'").select(_number("get(p, 1)", "long", line).alias("id"), _number("get(p, 2)", "double", line).alias("label"), "at")
    e = split.where("p[0] = 'e'").select(_number("get(p, 1)", "long", line).alias("src"), _number("get(p, 2)", "long", line).alias("dst"), _number("get(p, 3)", "double", line).alias("label"), "at")
    return v, e


def read_lg(spark: SparkSession, path: str, min_label_count: int = 0) -> Graph:
    """A graph from .lg files. Of repeated vertices or pairs the first line wins; labels rarer than
    min_label_count are left out with their vertices. Files are split like any text."""
    text = spark.read.text(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    graph = Graph.clean(*parse_lg(text.select("value", at.alias("at"))), order="at")
    return graph.frequent_labels(min_label_count) if min_label_count > 1 else graph


def from_text(spark: SparkSession, text: str, min_label_count: int = 0) -> Graph:
    """A graph from a small .lg text."""
    rows = [(line, k) for k, line in enumerate(text.split("\n"))]
    graph = Graph.clean(*parse_lg(spark.createDataFrame(rows, "value string, at long")), order="at")
    return graph.frequent_labels(min_label_count) if min_label_count > 1 else graph


def read_tables(spark: SparkSession, vertices: str, edges: str) -> Graph:
    """A graph from Parquet tables (id, label) and (src, dst, label)."""
    return Graph.clean(spark.read.parquet(vertices), spark.read.parquet(edges))


def lg_lines(graph: Graph) -> DataFrame:
    """The rows of a graph's .lg text, and their order: kind (header, v, e), then ids."""
    v = graph.vertices.select(F.lit(1).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.lit("v"), "id", "label").alias("value"))
    e = graph.edges.select(F.lit(2).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", F.lit("e"), "src", "dst", "label").alias("value"))
    head = graph.vertices.sparkSession.createDataFrame([(0, 0, 0, "# t 1")], "kind int, a long, b long, value string")
    return head.unionByName(v).unionByName(e)


def write_lg(graph: Graph, path: str) -> None:
    """Text parts that in order of their names make up the .lg file: a distributed sort, no single task."""
    lg_lines(graph).orderBy("kind", "a", "b").select("value").write.text(path)
