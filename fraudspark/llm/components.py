"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes in ``links`` (``u``, ``v``).

    Alternating stars: each node hands its larger neighbours to the smallest one it knows, then
    its smaller ones, until every edge ends in its component's smallest node. A round is two
    aggregates with map-side combine and two joins whose hot sides can be split; edges are written
    after each, never collected.
    """
    def star(edges: DataFrame, larger: bool) -> DataFrame:
        e = edges if larger else edges.where("u > v")
        both = e.union(e.select("v", "u")) if larger else e
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        low = stage(low, "star-minima")
        moved = both.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
        if larger:
            out = moved.where("a > u").select("a", "b")
        else:
            out = moved.select("a", "b").union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        return stage(out.distinct(), "star-edges")

    def mark(e: DataFrame) -> tuple:
        edge = F.xxhash64("u", "v")
        return tuple(e.agg(F.count("*"), F.bit_xor(edge), F.sum(edge.cast("decimal(38,0)"))).first())

    edges = stage(
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "star-edges",
    )
    old = None
    while old != (now := mark(edges)):
        old = now
        edges = star(star(edges, True), False)
    low = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return low.union(edges.select("v", "v").distinct())
