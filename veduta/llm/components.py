"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veduta.llm.tables import discard, stored


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v. Grouping by a second, constant column keeps the
    result from being taken as partitioned by u, so that the join on u has exchanges of its own on
    both sides and adaptive execution can split a hub."""
    return edges.groupBy("u", F.pmod("u", F.lit(1)).alias("_z")).agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = _least(down)
    moved = down.join(least, F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node reachable.

    ``edges`` has long columns u and v; null ends and loops are ignored, repeated and reversed edges
    count once, no edges give no rows. Each round halves distances and is stored; rounds end
    when the edges have become stars. Only two numbers a round reach the driver."""
    stars = stored(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark, before = now, stars
        stars = stored(_small_star(_large_star(before)))
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
