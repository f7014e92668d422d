"""Connected components as DataFrame joins: large-star and small-star until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolume.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node that has an edge (u, v); the root is the component's least node and lists itself.

    Each round is written to the shared folder, which cuts the lineage. Rounds grow with the logarithm of the
    number of nodes; a graph that has not settled after most_rounds raises.
    """
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = stored(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
        before = state
    raise RuntimeError("components did not settle")
