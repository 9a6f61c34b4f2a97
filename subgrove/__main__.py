"""python -m subgrove GRAPH.lg --support N: mines a graph and writes its frequent patterns as numbered .lg text."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import mining as M
from .sources import lg


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="subgrove", description=__doc__)
    p.add_argument("graph", help=".lg file or folder of its parts")
    p.add_argument("--support", type=int, default=9460, help="least MNI")
    p.add_argument("--max-edges", type=int)
    p.add_argument("--max-nodes", type=int)
    p.add_argument("--min-label-count", type=int, default=0, help="leave out vertices of rarer labels")
    p.add_argument("--phase", choices=("exact", "approx", "both"), default="both", help="exact supports, sampled ones, or exact ones after sampled ones")
    p.add_argument("--min-samples", type=int, default=60)
    p.add_argument("--samples", type=int, default=300)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--out", required=True, help="folder for the text")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    own = options().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    config = M.Config(own.support, own.max_edges, own.max_nodes, min_samples=own.min_samples, sample_size=own.samples, seed=own.seed)
    how = {"exact": M.mine, "approx": M.mine_approx, "both": M.mine_two_phase}[own.phase]
    M.write_result(how(lg.read_lg(spark, own.graph, own.min_label_count), config), own.out)


if __name__ == "__main__":
    main()
