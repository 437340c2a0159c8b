"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    out = both.join(least, "a").where(F.col("b") > F.col("a"))
    return out.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where(F.col("a") > F.col("m"))
    kept = least.select(F.col("m").alias("a"), "b")
    return kept.unionByName(moved.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (a, b: long); root is the least node of its component.

    Self links and rows with nulls are ignored, repeated links count once, no links give no rows. Each round is
    written to the shared folder. Hot nodes are met by map-side minima and by joins that AQE may split.
    """
    clean = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = scratch.table(clean, "links-0")
    before = _state(edges)
    for turn in range(1, max_rounds + 1):
        edges = scratch.table(_small_star(_large_star(edges)), f"links-{turn}")
        scratch.drop(f"links-{turn - 1}")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
