"""Connected components as DataFrame joins (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.storage import stage, unstage


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written out, and their number and checksum, which the same job observes."""
    seen = Observation()
    out = stage(e.observe(seen, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("sum")), "edges")
    return out, (seen.get["n"], seen.get["sum"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge between two different nodes; component is the least node.

    Each round is two aggregations and two equi-joins whose hub keys AQE can split; the edge list never grows, and each
    round's list is written to the shared folder, so the plan stays short and a lost executor costs one round.
    Edges with a null end and loops are left out; repeated edges count once; no edges give no rows.
    """
    a, b = F.col(src), F.col(dst)
    e, seen = _written(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after, now = _written(_small_star(_large_star(e)))
        unstage(e)
        e = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
