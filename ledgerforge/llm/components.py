"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of `edges`; the component is its smallest node.

    Each step replaces edges by ones to the smallest neighbour, so their number never
    grows; steps end when nothing changes. Minima are aggregated before anything is joined to
    them, so a node with very many links is one row on that side. Each step is written to
    the shared folder; only a count and a checksum reach the driver.
    """
    current = stored(_downwards(edges, a, b).distinct())
    state = _state(current)
    while state[0]:
        current = _step(current)
        now = _state(current)
        if now == state:
            break
        state = now
    return current.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )


def contracted(edges: DataFrame, steps: int, a: str = "a", b: str = "b") -> DataFrame:
    """(high, low) edges that connect what `edges` connect, after so many steps towards stars."""
    current = _downwards(edges, a, b)
    for _ in range(steps):
        current = _step(current)
    return current


def labels(stars: DataFrame) -> DataFrame:
    """(node, component) of the nodes of contracted edges that have a smaller neighbour, its smallest.

    Nodes with the same component are connected; connected nodes that are not yet in one star
    may have different ones.
    """
    return stars.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))


def _downwards(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).filter("high <> low")


def _step(current: DataFrame) -> DataFrame:
    """One large-star and one small-star step, each a minimum joined back to a stored table."""
    ways = F.array(F.struct(F.col("high").alias("u"), F.col("low").alias("v")), F.struct(F.col("low").alias("u"), F.col("high").alias("v")))
    both = current.select(F.inline(ways))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")))
    small = large.join(large.groupBy("high").agg(F.min("low").alias("m")), "high")
    moved = F.array(F.struct(F.col("low").alias("high"), F.col("m").alias("low")), F.struct("high", F.col("m").alias("low")))
    return stored(small.select(F.inline(moved)).filter("high <> low").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return row[0], row[1]
