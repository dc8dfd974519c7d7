"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that isn't the smallest of its component; root is the smallest."""
    a, b = F.col("a"), F.col("b")
    edges = stored(
        edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), a).alias("low"))
        large = both.join(lowest, "a").filter(b > a).select(b.alias("a"), F.col("low").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(nearest, "a").filter("b != low").select(b.alias("a"), F.col("low").alias("b"))
        edges = stored(small.union(nearest.select("a", F.col("low").alias("b"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(a.alias("node"), b.alias("root"))
