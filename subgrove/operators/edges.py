"""Edge patterns: their supports, the frequent ones, and joins of edge patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pattern import Pattern, two_edge
from ..plans.graph import Graph


def edge_patterns(graph: Graph) -> DataFrame:
    """la <= lb, el and mni, the lesser number of distinct vertices at either end.

    Vertices that have edges of a kind are counted once each, by their kinds, so no edge is dealt out; the other end of a kind is the kind
    the other way round. Where both labels are equal both directions are counted at both ends.
    """
    starts = graph.cached().kinds.groupBy("src_label", "label", "dst_label").agg(F.count("*").alias("n"))
    ends = starts.select(F.least("src_label", "dst_label").alias("la"), F.greatest("src_label", "dst_label").alias("lb"), F.col("label").alias("el"), "n")
    return ends.groupBy("la", "lb", "el").agg(F.min("n").alias("mni"))


def frequent_edges(graph: Graph, support: int) -> DataFrame:
    return edge_patterns(graph).where(F.col("mni") >= support)


def two_edge_candidates(frequent: DataFrame) -> dict[str, Pattern]:
    """Distinct two-edge patterns of the frequent edge patterns (a table of label combinations, which is small), by code."""
    return two_edge([(r["la"], r["lb"], r["el"]) for r in frequent.collect()])
