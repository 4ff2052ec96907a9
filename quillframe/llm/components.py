"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import discard, stored


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v only and no v is a u: then each v is the root of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("top")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("top").alias("top"))
    return not ends.agg(F.count_if((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("top") > 0)))).first()[0]


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node with an edge; ``edges`` has columns a and b of one type.

    ``known`` is the result for earlier edges of the same graph: ``edges`` then
    holds the new ones only, and of the earlier nodes only roots take part in the rounds.

    The root is the smallest node reachable. Each round replaces neighbours by
    the smallest one known, first for larger neighbours, then for smaller ones;
    only minima per node are aggregated, so a hot node is never gathered. Every
    round is written to the shared folder, and rounds end when each node points straight to
    a root. Nodes joined only to themselves, and nulls, are left out; an empty table gives none.
    """
    if known is not None:
        for c in ("a", "b"):
            edges = edges.join(known.toDF(c, "known_root"), c, "left")
            edges = edges.withColumn(c, F.coalesce("known_root", c)).drop("known_root")
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
        "edges",
    )
    if known is not None and now.isEmpty():
        discard(now)
        return known
    # Edges point from the larger node to the smaller.
    while not _stars(now):
        # Small stars on (larger u, smaller v), then large stars on both directions.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least)
        both = small.union(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(large.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(before)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    if known is None:
        return found
    found = stored(found, "merged")
    moved = known.join(found.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.union(found.join(known.select("node"), "node", "left_anti"))
