"""Connected groups of things that are filed under the same keys, without all pairs of a key.

`linked_groups` gets rows (node, tile), a node being filed under every tile where a partner
may lie, and a function that keeps those of given pairs that link. A tile may hold a third of all nodes, so
its members are not paired with one another. First they are compared with one member, the
one with the most company in all its tiles (in a group of near copies that is what they are copies
of), then those still apart with another member of the tile's largest component. Only tiles that hold more
than one component after that are joined with themselves, for members of different components,
leaving out pairs within the largest. So no link between different components is lost, and links within
a component, which cannot change it, are not looked for.

Most tiles have very few members, that share a part by chance. In tiles of ``FEW_NODES`` or less every pair is met at once,
so they are not compared again.

A tile of many nodes can still hold many components then, say lines of one form whose slots differ. Where the caller can name parts
of a node of which two that link have one in common, tiles of more than ``MANY_NODES`` nodes are dealt again by these, so that
their members are not all paired with one another.

Tiles of one node are found by a grouped minimum and maximum of 64 bits, before any member is shuffled.
Near copies share most of their tiles: of tiles with the same members one is kept (told by their number and
128 bits of their digests), so the same pairs are not met once a tile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillframe.llm.common import discard, stored
from quillframe.llm.components import components

# Tiles brought to every task rather than shuffling the nodes: at most so many (16 bytes each).
LIVE_TILES = 2_000_000
# Tiles of so many nodes are joined with themselves in the first round: at most 6 pairs for 4 rows.
FEW_NODES = 4
# Tiles of more nodes, still apart, are dealt again by parts of nodes: below, no node is in more pairs.
MANY_NODES = 32


def _live(filed: DataFrame) -> DataFrame:
    """The rows of tiles with two nodes or more, once each."""
    mixed = F.col("node") if filed.schema["node"].dataType == LongType() else F.xxhash64("node")
    ends = filed.groupBy("tile").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high"))
    tiles = stored(ends.filter("low <> high").select("tile"), "live-tiles")
    side = F.broadcast(tiles) if tiles.count() <= LIVE_TILES else tiles
    rows = stored(filed.join(side, "tile", "left_semi").distinct(), "tile-rows")
    discard(tiles)
    return rows


def _unlike(rows: DataFrame) -> DataFrame:
    """The rows of one of the tiles with the same nodes, with its size and weight, the number of nodes in all of these."""
    codes = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"code{i}") for i in range(2)]
    kinds = rows.groupBy("tile").agg(F.count("node").alias("size"), *codes).groupBy("size", "code0", "code1")
    kinds = kinds.agg(F.min("tile").alias("tile"), F.count("tile").alias("times"))
    kinds = stored(kinds.select("tile", "size", (F.col("size") * F.col("times")).alias("weight")), "tile-kinds")
    side = F.broadcast(kinds) if kinds.count() <= LIVE_TILES else kinds
    kept = stored(rows.join(side, "tile").select(*rows.columns, "size", "weight"), "tile-rows")
    discard(kinds)
    return kept


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of tiles whose members are in two components or more, with the root of each, computed once.

    A tile whose members are one component has no link left that could change it.
    """
    now = rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = stored(now, "tile-roots")
    kept = _of_two_roots(now)
    discard(now)
    return kept


def _of_two_roots(rows: DataFrame) -> DataFrame:
    """The rows of tiles whose members have two roots or more."""
    ends = rows.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return stored(rows.join(ends.filter("low <> high").select("tile"), "tile", "left_semi"), "tile-rows")


def _dealt_again(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows, those of tiles of many nodes once for each part of a node, under the tile and the part; sizes stay."""
    many = F.col("size") > MANY_NODES
    finer = rows.filter(many).join(parts, "node").withColumn("tile", F.xxhash64("tile", "part")).select(*rows.columns)
    finer = stored(finer.distinct(), "tile-parts")
    kept = _of_two_roots(rows.filter(~many).union(finer))
    discard(finer)
    return kept


def linked_groups(
    filed: DataFrame,
    link: Callable[..., DataFrame],
    side: DataFrame | None = None,
    may: Callable[[str, str], Column] | None = None,
    ready: Callable[[DataFrame], DataFrame] | None = None,
    parts: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """(node, root) of every node with a link; ``link`` returns the (a, b) of given pairs that link, a < b.

    ``side`` (node, ...), or further columns of ``filed``, have what ``may`` needs of two nodes to tell pairs that
    cannot link; it is given the suffixes of their columns. ``ready`` is given the nodes that pairs may hold, once,
    and makes the `stored` table that ``link`` gets with the pairs. ``parts`` is given some nodes, and that table, and
    makes a `stored` (node, part): two nodes that link have a part in common.
    """
    live = _live(filed)
    first = _unlike(live)
    discard(live)
    extra = [c for t in (filed, side) if t is not None for c in t.columns if c not in ("tile", "node")]
    if may is None:
        may = lambda a, b: F.lit(True)
    is_small = F.col("size") <= FEW_NODES

    def informed(some: DataFrame) -> DataFrame:
        return some if side is None else some.join(side, "node")

    def met(some: DataFrame, others: DataFrame, *more: str) -> DataFrame:
        """The pairs of members of a tile that may link; their columns have the suffixes _a and _b."""
        x, y = [t.select("tile", *[F.col(c).alias(f"{c}_{s}") for c in ("node", *extra, *more)]) for s, t in (("a", some), ("b", others))]
        return x.join(y, "tile").filter(may("_a", "_b"))

    small = stored(informed(first.filter(is_small)).select("tile", "node", *extra), "tile-few")
    many = first.filter(~is_small)
    company = first.groupBy("node").agg(F.sum("weight").alias("company"))
    rows = stored(informed(many.drop("weight").join(company, "node")), "tile-rows")
    given = [] if ready is None else [ready(first.select("node").distinct())]
    few = met(small, small).filter("node_a < node_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    # At first each member is a component, and the one with the most company speaks for its tile.
    rank = F.struct(F.col("company"), F.col("node"), *extra)
    lead = rows.groupBy("tile").agg(F.max(rank).alias("head")).withColumn("lead_root", F.col("head.node"))
    wide = rows.withColumn("root", F.col("node"))
    # Without the columns of ``side``; they are looked up again for large tiles still apart.
    now, roots = first.drop("weight"), None
    for turn in range(2 if parts is None else 3):
        if turn == 2:
            asked = now.filter(F.col("size") > MANY_NODES).select("node").distinct()
            if asked.isEmpty():
                break
            passed, some = now, parts(asked, *given)
            now = _dealt_again(now, some)
            discard(passed, some)
        if turn:
            # A tile's components, with the member that speaks for each.
            rank = F.struct(F.xxhash64("node", "tile"), F.col("node"), *extra)
            wide = stored(informed(now.filter(~is_small)), "tile-rows")
            groups = wide.groupBy("tile", "root").agg(F.count("node").alias("size"), F.max(rank).alias("head"))
            lead = groups.groupBy("tile").agg(F.max(F.struct("size", "head", "root")).alias("lead"))
            lead = lead.select("tile", F.col("lead.head").alias("head"), F.col("lead.root").alias("lead_root"))
        lead = lead.select(
            "tile", F.col("head.node").alias("lead"), "lead_root", *[F.col(f"head.{c}").alias(f"{c}_lead") for c in extra]
        )
        stars = wide.join(lead, "tile").filter((F.col("root") != F.col("lead_root")) & may("", "_lead"))
        stars = stars.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
        found = link((stars if turn else stars.union(few)).distinct(), *given)
        before, roots = roots, stored(components(found, known=roots), "tile-roots")
        passed, now = now if turn else first, _apart(now, roots)
        discard(found, before, passed, *((wide,) if turn else (rows, small)))

    large = now.filter(~is_small)
    most = large.groupBy("tile", "root").agg(F.count("node").alias("size"))
    most = most.groupBy("tile").agg(F.max(F.struct("size", "root")).alias("most")).select("tile", F.col("most.root").alias("most"))
    rest = stored(informed(large.join(most, "tile")).select("tile", "node", "root", "most", *extra), "tile-rest")
    pairs = met(rest.filter("root <> most"), rest, "root", "most").filter(
        (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("most_b")) | (F.col("node_a") < F.col("node_b")))
    )
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    found = link(pairs, *given)
    out = stored(components(found, known=roots), "tile-roots")
    discard(found, roots, now, rest, *given)
    return out
