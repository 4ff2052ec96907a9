"""Rank all documents for many queries at once, evaluating shared sums of terms once.

1. Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
   Items (the queries) are numbered along a MinHash of their terms, so that alike items are
   neighbours, and dealt to blocks of ``block_items``.
2. In each block, shared term sets are mined: terms held by exactly the same items form one
   atom; then, again and again, the two nodes that most items hold together become a sum node,
   which takes their place in these items. What results is a graph of sums that the items
   share; each item is a sum of few of its nodes.
3. Documents are read once for each ``items_at_once`` items: their length, and the counts of terms
   that occur in those items, are written to the shared folder. Document frequencies are counted there.
4. Each task goes through its documents in batches. The accumulators of a batch (a row of
   scores for each node) are filled from the counts for atoms, and for a sum by adding two rows; an
   item's scores are the sum of its nodes' rows. So a shared term set is summed up once.
   Of each item a task keeps the k best; at most k rows a task and item are shuffled and ranked.

A document is never looked at alone with a query, and no posting is shuffled: only
(item, document, score) of each task's best is. Scores are whole numbers; the graph changes the
order of additions only.

Ties go to the smaller document id (null first). Documents without terms, null and empty ones
among them, count for nothing and are never found; items without terms have no rows. Repeated
document rows are ranked one by one. Item rows equal in id and text are one item; rows of one id
with different texts are ranked each for itself. Texts of any length are read whole. Empty
tables give an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillframe.llm.common import map_rows, small_batches, stored, utf8
from quillframe.support import numbered

K, BLOCK_ITEMS, ITEMS_AT_ONCE = 50, 128, 2048
# Of the atoms that items share, so many of the most shared take part in the mining of sums; the
# others are added one by one. It bounds the work of mining and cannot change a score.
MINED_ATOMS = 1500
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def text_terms(t: bytes) -> list[bytes]:
    """The terms of a UTF-8 text with repeats."""
    return t.translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def mine(items: list[list[bytes]], mined: int = MINED_ATOMS) -> tuple[list[list[bytes]], list[tuple[int, int]], list[list[int]]]:
    """(atoms, sums, roots) of the items' term lists.

    Node i is atom i (a list of terms), or, after the atoms, the sum of two earlier nodes. The
    terms below an item's roots are its terms, each once.
    """
    holders: dict[bytes, int] = {}
    for i, terms in enumerate(items):
        for t in terms:
            holders[t] = holders.get(t, 0) | 1 << i
    grouped: dict[int, list[bytes]] = {}
    for t, held in sorted(holders.items()):
        grouped.setdefault(held, []).append(t)
    atoms = list(grouped.values())
    uses = list(grouped)
    shared = sorted((a for a in range(len(atoms)) if uses[a].bit_count() > 1), key=lambda a: (-uses[a].bit_count(), a))
    live = shared[:mined]
    heap = [
        (-both, a, b)
        for n, a in enumerate(live)
        for b in live[n + 1 :]
        if (both := (uses[a] & uses[b]).bit_count()) > 1
    ]
    heapq.heapify(heap)
    sums: list[tuple[int, int]] = []
    while heap:
        gain, a, b = heapq.heappop(heap)
        both = uses[a] & uses[b]
        if both.bit_count() < 2:
            continue
        if both.bit_count() < -gain:
            heapq.heappush(heap, (-both.bit_count(), a, b))
            continue
        node = len(uses)
        sums.append((a, b))
        uses[a] &= ~both
        uses[b] &= ~both
        for other in live:
            if (together := (uses[other] & both).bit_count()) > 1:
                heapq.heappush(heap, (-together, other, node))
        uses.append(both)
        live.append(node)
    roots: list[list[int]] = [[] for _ in items]
    for node, held in enumerate(uses):
        while held:
            low = held & -held
            roots[low.bit_length() - 1].append(node)
            held ^= low
    return atoms, sums, roots


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(number, item, terms), the terms distinct; neighbours in number are alike."""

    def make():
        import xxhash

        def work(given: dict[str, list]) -> dict[str, list]:
            terms = [sorted(set(text_terms(t))) for t in given["text"]]
            low = [min((xxhash.xxh3_64_intdigest(x) >> 1 for x in t), default=0) for t in terms]
            return {"item": given["item"], "text": given["text"], "terms": terms, "low": low}

        return work

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).distinct()
    rows = map_rows(rows, {"item": F.col("item"), "text": utf8("text")}, make, f"item {kind}, text binary, terms array<binary>, low long")
    return numbered(rows.filter(F.size("terms") > 0), [F.col("low"), F.col("item"), F.col("text")]).select("number", "item", "terms")


def _graphs(part: DataFrame, block_items: int) -> list[dict]:
    """The sharing graph of each block, mined in tasks: [{atoms, sums, roots, numbers}]."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["number"].to_pylist(), table["terms"].to_pylist(), strict=True))
        atoms, sums, roots = mine([t for _, t in rows])
        return pa.table(
            {"numbers": [[n for n, _ in rows]], "atoms": [atoms], "sums": [[list(s) for s in sums]], "roots": [roots]},
            pa.schema(
                {
                    "numbers": pa.list_(pa.int64()),
                    "atoms": pa.list_(pa.list_(pa.binary())),
                    "sums": pa.list_(pa.list_(pa.int32())),
                    "roots": pa.list_(pa.list_(pa.int32())),
                }
            ),
        )

    schema = "numbers array<long>, atoms array<array<binary>>, sums array<array<int>>, roots array<array<int>>"
    block = F.floor(F.col("number") / block_items).alias("block")
    return [r.asDict() for r in part.select(block, "number", "terms").groupBy("block").applyInArrow(run, schema).collect()]


def _counts(docs: DataFrame, id_col: str, text_col: str, terms: list[bytes]) -> DataFrame:
    """(id, n, terms, counts) of every document: its length, and its counts of the listed terms by their places."""
    places = {t: i for i, t in enumerate(terms)}

    def make():
        place = places.get

        def work(given: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"id": given["id"], "n": [], "terms": [], "counts": []}
            for t in given["text"]:
                found = text_terms(t)
                known = np.array([p for p in map(place, found) if p is not None], np.int32)
                which, times = np.unique(known, return_counts=True)
                out["n"].append(len(found))
                out["terms"].append(which)
                out["counts"].append(times)
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    columns = {"id": F.col(f"`{id_col}`"), "text": utf8(text_col)}
    return map_rows(docs, columns, make, f"id {kind}, n long, terms array<int>, counts array<long>")


class _Best:
    """The k best documents of one item seen so far, and a few more."""

    def __init__(self, k: int):
        self.k, self.least, self.rows = k, 1, []

    def add(self, scores: np.ndarray, ids: list) -> None:
        at = np.flatnonzero(scores >= self.least)
        if len(at):
            self.rows += zip(scores[at].tolist(), [ids[i] for i in at], strict=True)
            if len(self.rows) > 4 * self.k:
                self.cut()

    def cut(self) -> list:
        self.rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1]))
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.least = self.rows[-1][0]
        return self.rows


def accumulators(size: int, sums: list, atom_of: np.ndarray, docs: int, owner: np.ndarray, terms: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """A row of sums for each node of the graph, a column for each document."""
    acc = np.zeros((size, docs), np.int64)
    atom = atom_of[terms]
    mine = atom >= 0
    np.add.at(acc, (atom[mine], owner[mine]), scores[mine])
    for i, (a, b) in enumerate(sums, size - len(sums)):
        np.add(acc[a], acc[b], out=acc[i])
    return acc


def _best(counts: DataFrame, terms: list[bytes], graphs: list[dict], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(number, id, score): for each item the k best of each task."""
    places = {t: i for i, t in enumerate(terms)}
    plans = []
    for g in graphs:
        atom_of = np.full(len(terms), -1, np.int32)
        for a, members in enumerate(g["atoms"]):
            atom_of[[places[bytes(t)] for t in members]] = a
        plans.append((g["numbers"], atom_of, len(g["atoms"]) + len(g["sums"]), g["sums"], g["roots"]))
    small_batches(counts.sparkSession)
    out = T.StructType([T.StructField("number", T.LongType()), T.StructField("id", counts.schema["id"].dataType), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        best = {n: _Best(k) for numbers, *_ in plans for n in numbers}
        for batch in batches:
            lists = batch.column("terms")
            owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            found = lists.flatten().to_numpy()
            tf = batch.column("counts").flatten().to_numpy()
            m = 50 + (50 * n_docs * batch.column("n").to_numpy()) // max(n_terms, 1)
            scores = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
            ids = batch.column("id").to_pylist()
            for numbers, atom_of, size, sums, roots in plans:
                acc = accumulators(size, sums, atom_of, len(batch), owner, found, scores)
                for n, nodes in zip(numbers, roots, strict=True):
                    best[n].add(acc[nodes].sum(axis=0), ids)
        kind = to_arrow_type(out["id"].dataType)
        for n, kept in best.items():
            rows = kept.cut()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(rows), pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[0] for r in rows], pa.int64())],
                    names=["number", "id", "score"],
                )

    return counts.filter(F.size("terms") > 0).select("id", "n", "terms", "counts").mapInArrow(run, out)


def rank(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    items_at_once: int = ITEMS_AT_ONCE,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(item, rank, id, score): the k best documents of each item with a score above 0."""
    asked = _items(items, item_col, item_text_col)
    total = asked.count()
    found = None
    for start in range(0, max(total, 1), items_at_once):
        part = asked.filter((F.col("number") >= start) & (F.col("number") < start + items_at_once))
        graphs = _graphs(part, block_items)
        # The terms of a bounded number of items.
        terms = sorted({bytes(t) for g in graphs for atom in g["atoms"] for t in atom})
        counts = stored(_counts(docs, id_col, text_col, terms), "term-counts")
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = dict(tuple(r) for r in held)
        weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(terms))], np.int64)
        one = stored(_best(counts, terms, graphs, weights, n_docs, n_terms, k), "best-of-tasks")
        found = one if found is None else found.unionByName(one)
    order = [F.desc("score"), F.asc_nulls_first("id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k)
    named = ranked.join(asked.select("number", "item"), "number")
    return named.select("item", "rank", "id", "score")
