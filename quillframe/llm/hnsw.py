"""Nearest neighbours by inner product: one hierarchical small-world graph per shard.

Vectors are dealt to shards by a hash of their contents, about ``shard_rows``
different ones to each. A shard's graph is a set of layers, each a flat array of
neighbour numbers (row i: the neighbours of node i, -1 where there are fewer);
it is stored in the shared folder as one row. Queries, in blocks, are sent to every
shard; a block descends the layers together, and the shards' answers are merged.

Within a shard the graph compares vectors made equally long by one more
coordinate, which leaves inner products with queries as they are. Copies of a
vector are one node that knows its k + 1 smallest ids: ties go to smaller ids, so
further copies can never be in an answer. Scores are computed in double precision
from the stored numbers.

Vectors that are null, zero, or hold a null or non-finite component take no part;
vectors of different lengths are not compared; ids may repeat (each row is a
candidate, but never for its own id); fewer candidates than k give fewer rows; an
empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm.common import stored

SHARD_ROWS, QUERY_ROWS, BLOCKS_AT_ONCE = 8192, 512, 8
LINKS, WIDTH_BUILD, WIDTH_SEARCH, BATCH = 16, 96, 160, 256
# Candidates that a beam opens at a time.
OPENED = 4
# The node on all layers, from which every descent starts.
FIRST = 0


class Layer:
    """Nodes of one layer and their flat neighbour array; nodes are numbers of the shard's rows."""

    def __init__(self, rows: int, links: int):
        self.near = np.full((rows, links), -1, np.int32)


def beam(x: np.ndarray, q: np.ndarray, near: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``width`` nodes found for each query, best first, by opening the best unopened ones."""
    m = len(q)
    seen = np.zeros((m, len(x)), bool)
    rows = np.arange(m)[:, None]
    ids = np.full((m, width), -1, np.int32)
    score = np.full((m, width), -np.inf, np.float32)
    opened = np.ones((m, width), bool)
    ids[:, 0], opened[:, 0] = entry, False
    score[:, 0] = np.einsum("qd,qd->q", x[entry], q)
    seen[np.arange(m), entry] = True
    live = np.arange(m)
    while len(live):
        waiting = np.where(opened[live], -np.inf, score[live])
        take = np.argpartition(-waiting, min(OPENED, width) - 1, axis=1)[:, :OPENED]
        some = np.take_along_axis(waiting, take, 1) > -np.inf
        keep = some.any(axis=1)
        live, take, some = live[keep], take[keep], some[keep]
        if not len(live):
            break
        heads = np.where(some, np.take_along_axis(ids[live], take, 1), -1)
        opened[live[:, None], take] = True
        found = np.where(heads[:, :, None] >= 0, near[heads], -1).reshape(len(live), -1)
        fresh = (found >= 0) & ~seen[live[:, None], found]
        seen[live[:, None], np.where(fresh, found, entry[live][:, None])] = True
        got = np.einsum("qnd,qd->qn", x[found], q[live])
        # One node may be the neighbour of several heads: only its first mention counts.
        order = np.argsort(found, axis=1, kind="stable")
        lined = np.take_along_axis(found, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], lined[:, 1:] == lined[:, :-1], 1)
        got = np.where(fresh & ~twice, got, -np.inf).astype(np.float32)
        all_score = np.concatenate([score[live], got], axis=1)
        all_ids = np.concatenate([ids[live], found], axis=1)
        all_open = np.concatenate([opened[live], np.zeros_like(fresh)], axis=1)
        best = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        score[live] = np.take_along_axis(all_score, best, 1)
        ids[live] = np.take_along_axis(all_ids, best, 1)
        opened[live] = np.take_along_axis(all_open, best, 1) | (score[live] == -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = ids[rows, order], score[rows, order]
    return np.where(score > -np.inf, ids, -1), score


def spread_out(x: np.ndarray, node: int, others: np.ndarray, links: int) -> np.ndarray:
    """Of ``others``, best first, those nearer to the node than to any one chosen before; then the best rest."""
    to_node = x[others] @ x[node]
    order = np.argsort(-to_node, kind="stable")
    others, to_node = others[order], to_node[order]
    if len(others) <= links:
        return others
    among = x[others] @ x[others].T
    chosen: list[int] = []
    barred = np.full(len(others), -np.inf)
    for i in range(len(others)):
        if to_node[i] > barred[i]:
            chosen.append(i)
            if len(chosen) == links:
                break
            np.maximum(barred, among[i], out=barred)
    if len(chosen) < links:
        chosen += [i for i in range(len(others)) if i not in set(chosen)][: links - len(chosen)]
    return others[chosen]


def build(x: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Flat neighbour arrays, the widest (all nodes) first; nodes join in batches, upper layers first."""
    n = len(x)
    levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
    levels[FIRST] = max(levels.max(), 1)
    order = np.argsort(-levels, kind="stable")
    layers: list[np.ndarray] = []
    for level in range(int(levels[FIRST]), -1, -1):
        nodes = order[: int((levels >= level).sum())]
        links = 2 * LINKS if level == 0 else LINKS
        near = np.full((n, links), -1, np.int32)
        for at in range(0, len(nodes), BATCH):
            batch = nodes[at : at + BATCH]
            among = x[batch] @ x[batch].T
            np.fill_diagonal(among, -np.inf)
            close = np.argsort(-among, axis=1)[:, : min(len(batch) - 1, WIDTH_BUILD // 2)]
            if at:
                ids, _ = beam(x, x[batch], near, descend(x, x[batch], layers, FIRST), WIDTH_BUILD)
            wanted: dict[int, list[int]] = {}
            for i, node in enumerate(batch.tolist()):
                pool = batch[close[i]]
                if at:
                    pool = np.concatenate([ids[i][ids[i] >= 0], pool])
                chosen = spread_out(x, node, pool, LINKS)
                near[node, : len(chosen)] = chosen
                for c in chosen.tolist():
                    wanted.setdefault(c, []).append(node)
            for c, new in wanted.items():
                old = near[c][near[c] >= 0]
                pool = np.unique(np.concatenate([old, new]))
                chosen = pool if len(pool) <= links else spread_out(x, c, pool, links)
                near[c] = -1
                near[c, : len(chosen)] = chosen
        layers.insert(0, near)
    return layers


def descend(x: np.ndarray, q: np.ndarray, upper: list[np.ndarray], start: int) -> np.ndarray:
    """Entry nodes for the layer below ``upper`` (widest first)."""
    entry = np.full(len(q), start)
    for near in reversed(upper):
        entry = beam(x, q, near, entry, 8)[0][:, 0]
    return entry


def equal_length(v: np.ndarray) -> np.ndarray:
    squares = (v * v).sum(axis=1)
    return np.concatenate([v, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)


def _usable(column: Column) -> Column:
    fine = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return column.isNotNull() & fine & F.exists(column, lambda c: c != 0)


INDEX = "shard long, dim int, rows int, vectors binary, ids binary, ends binary, layers array<binary>"


def _up_to(last: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))


def _shard_row(table: pa.Table) -> pa.Table:
    """One shard's distinct vectors to its graph."""
    ids = table["ids"].to_pylist()
    v = np.stack([np.asarray(x, np.float64) for x in table["v"].to_pylist()])
    layers = build(equal_length(v))
    return pa.table(
        {
            "shard": table["shard"][:1],
            "dim": table["dim"][:1],
            "rows": pa.array([len(v)], pa.int32()),
            "vectors": pa.array([v.tobytes()], pa.binary()),
            "ids": pa.array([np.array([i for some in ids for i in some], np.int64).tobytes()], pa.binary()),
            "ends": pa.array([np.cumsum([len(some) for some in ids]).astype(np.int64).tobytes()], pa.binary()),
            "layers": pa.array([[a.tobytes() for a in layers]], pa.list_(pa.binary())),
        }
    )


def index(df: DataFrame, id_col: str, vec_col: str, k: int, shard_rows: int) -> DataFrame:
    """One stored row per shard: vectors, ids and flat neighbour arrays. Every usable vector is in it."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(_usable(F.col("v")))
    rows = rows.filter(F.col("id").isNotNull())
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    nodes = stored(rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    return stored(nodes.groupBy("shard", "dim").applyInArrow(_shard_row, INDEX), "graphs")


def _block_row(table: pa.Table) -> pa.Table:
    v = np.stack([np.asarray(x, np.float64) for x in table["v"].to_pylist()])
    ids = np.asarray(table["id"].to_pylist(), np.int64)
    return pa.table(
        {
            "dim": table["dim"][:1],
            "block": table["block"][:1],
            "queries": pa.array([ids.tobytes()], pa.binary()),
            "wanted": pa.array([v.tobytes()], pa.binary()),
        }
    )


def search(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``df`` for each row of ``queries`` but the one of its id."""
    graphs = index(df, id_col, vec_col, k, shard_rows)
    v = F.col(f"`{vec_col}`").cast("array<double>")
    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    asked = asked.filter(_usable(F.col("v")) & F.col("id").isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed = asked.groupBy("dim", "block").applyInArrow(_block_row, "dim int, block long, queries binary, wanted binary")
    packed = packed.withColumn("part", F.expr(f"block div {BLOCKS_AT_ONCE}"))
    shards = graphs.agg(F.max("shard")).first()[0]
    parts = (blocks - 1) // BLOCKS_AT_ONCE
    sent = packed.withColumn("shard", F.explode(_up_to(int(shards or 0))))
    held = graphs.withColumn("part", F.explode(_up_to(parts)))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], []]
        for row in left.to_pylist():
            for found in _answers(row, right.to_pylist(), k):
                for held_, new in zip(columns, found, strict=True):
                    held_.append(new)
        flat = [np.concatenate(c) if c else np.zeros(0) for c in columns]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table(
            {n: pa.array(c.astype(t.to_pandas_dtype()), t) for n, c, t in zip(("query_id", "vec_id", "score"), flat, kinds, strict=True)}
        )

    keys = ["shard", "dim", "part"]
    found = (
        held.groupBy(*keys)
        .cogroup(sent.groupBy(*keys))
        .applyInArrow(answer, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(row: dict, blocks: list[dict], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's k best rows in one shard: nodes by the graph, then their ids, each query's own left out."""
    n, dim = row["rows"], row["dim"]
    v = np.frombuffer(row["vectors"]).reshape(n, dim)
    layers = [np.frombuffer(a, np.int32).reshape(n, -1) for a in row["layers"]]
    ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    x = equal_length(v)
    for block in blocks:
        asked = np.frombuffer(block["queries"], np.int64)
        q = np.frombuffer(block["wanted"]).reshape(len(asked), dim)
        long = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        nodes, _ = beam(x, long, layers[0], descend(x, long, layers[1:], FIRST), WIDTH_SEARCH)
        for i, own in enumerate(asked.tolist()):
            mine = nodes[i][nodes[i] >= 0]
            score = np.einsum("nd,d->n", v[mine], q[i])  # the same sum for a vector, whichever others are met
            best = np.argsort(-score, kind="stable")[: k + 1] if len(mine) > k + 1 else np.arange(len(mine))
            if len(mine) > k + 1:  # nodes that tie with the last one belong too
                best = np.flatnonzero(score >= score[best[-1]])
            rows = [(-score[b], i_) for b in best.tolist() for i_ in ids[starts[mine[b]] : ends[mine[b]]].tolist() if i_ != own]
            rows.sort()
            rows = rows[:k]
            if rows:
                yield (
                    np.full(len(rows), own),
                    np.array([r[1] for r in rows]),
                    np.array([-r[0] for r in rows]),
                )
