"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import staged


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    pulled = down.join(least, "u")
    return pulled.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node in ``edges`` (u, v).

    Null ends and self links are left out; repeated links count once. Each
    round's links are written to the shared folder, so a lost executor costs at
    most one round. Raises if they haven't settled after ``rounds``. A star that a third of all links lead to is only ever
    aggregated to its minimum and joined, never collected.
    """
    now = staged(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "links")
    mark = None
    for _ in range(rounds):
        now = staged(small_star(large_star(now)), "stars")
        next_mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if next_mark == mark:
            break
        mark = next_mark
    else:
        raise RuntimeError(f"components haven't settled within {rounds} rounds; allow more")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
