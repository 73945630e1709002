"""Connected components of an edge table, without collecting links anywhere.

Alternating large-star and small-star steps: each is one aggregation with
map-side partial minima and one equi-join whose hot keys AQE may split.  Every
step is written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import materialise


def _largest(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns a, b); the root is the component's smallest node."""
    current = edges.select("a", "b").where("a != b").distinct()
    seen = None
    for _ in range(most_rounds):
        current = materialise(_smallest(_largest(current)), "stars")
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            roots = current.select(F.col("b").alias("a"), "b").distinct()
            return current.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
        seen = state
    raise RuntimeError("components did not converge")
