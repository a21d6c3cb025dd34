"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = _least_neighbour(down)
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 0) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest node it reaches.

    edges: two LONG columns, in any direction, repeats and loops allowed; null ends are ignored. An empty
    table gives an empty table. Work is one aggregation and one join per step; no node's edges are gathered
    in a task (the aggregations combine before the shuffle, the joins can be split where keys are hot). Steps go on
    until nothing changes, which the method reaches from any table. most: a bound on the bytes of the edges, if known.
    """
    now, state = _written(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").distinct(), most)
    seen = None
    while state[0] and state != seen:
        seen = state
        nxt, state = _written(_small_star(_large_star(now).filter("u <> v").distinct()).distinct(), 16 * state[0])
        discard(now)
        now = nxt
    least = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least.select("node", F.col("node").alias("component")))


def _written(edges: DataFrame, most: int) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, their number and a sum of their hashes, counted as they are written."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), "edges", most=most)
    found = seen.get
    return out, (found["n"], found["h"])
