"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationwise.llm.common import copied_if_small, materialize

#: Nodes with more edges than this are hubs: their least neighbours go to the edges, not the edges to them.
HUB = 2_000


def _met(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """``(a, b, m)``: ``rows(a, b)`` with the ``m`` of ``least(x, m, n)`` for their ``a``; ``n`` counts the edges of ``x``.

    There is at most a hub for each ``hub`` edges; while that many are few enough to copy, no task gathers a hub's edges.
    """
    hubs = materialize(least.where(F.col("n") > hub).select(F.col("x").alias("h"), F.col("m").alias("hm")), "hubs")
    join = lambda edges: edges.join(least.select("x", "m"), F.col("a") == F.col("x")).select("a", "b", "m")
    if hubs.isEmpty():
        return join(rows)
    known = rows.join(copied_if_small(hubs, 40), F.col("a") == F.col("h"), "left")
    return join(known.where("h IS NULL")).unionByName(known.where("h IS NOT NULL").select("a", "b", F.col("hm").alias("m")))


def _least(edges: DataFrame, name: str) -> DataFrame:
    return materialize(edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), name)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "least-near").withColumn("m", F.least("x", "m"))
    return _met(both.where(F.col("b") > F.col("a")), least, hub).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-down")
    least = _least(down, "least-below")
    moved = _met(down, least, hub).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("x").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the component's least node.

    Self-loops, repeated edges and either direction are allowed; no edges give no rows.  Each round is
    two joins on the nodes and halves the paths at least, so a few rounds suffice.
    """
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        edges = materialize(_small_star(_large_star(edges, hub), hub).distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
