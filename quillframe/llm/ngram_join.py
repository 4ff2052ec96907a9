"""Exact Jaccard self-join of word n-gram sets: size-banded tiles, and bitmaps that bound the overlap.

1. Every text becomes the sorted array of 64-bit hashes of its distinct n-grams.
   Equal sets are one class; only one representative of a class goes on.
2. Sets are banded by size. Two sets that link and of which the larger lies in a band differ in
   at most k n-grams, k being the same for the band. Their n-grams are dealt to more than k parts by
   hash, so one part at least is equal in both. A set is filed under a tile, (band, part, digest
   of the part), for each part, in its own band and in those where larger partners may lie. A part of some six
   n-grams is rarely shared by chance, and a passage that many texts hold fills few whole parts.
   Empty parts are equal without saying much, so they are not filed: a set with too many of them
   for that is dealt once more in another way, until it has few (`deal`).
3. `tiles.linked_groups` compares the members of a tile and finds the connected groups. Pairs whose bitmaps
   of ``FOLD_BITS`` bits differ in more bits than linked sets can, are dropped inside the joins.
4. Each candidate pair passes the bitmap bound (the bits in which two parity
   bitmaps differ are a lower bound of the sets' difference) before the arrays
   are intersected.

So no link between different components is lost, while links inside a component,
which cannot change it, are not enumerated.

Null, empty and word-less texts have an empty set, no links and themselves as
component; texts are read whole; repeated rows are one class; an empty table
gives an empty result. Rows with one id but different texts are different nodes.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import discard, map_rows, stored, text_key, utf8
from quillframe.llm.tiles import linked_groups

# Sizes of a band differ by this factor at most; more tiles a set, or more bands to look in.
BAND_RATIO = 1.5
# Ways to deal n-grams to parts; the last one files empty parts too.
DEALS = 12
CACHE_WORDS = 200_000
# Bits of the bitmaps in the joins of tiles.
FOLD_BITS = 1024
# Ids brought to every task instead of shuffling texts: at most this many (8 bytes each).
BROADCAST_IDS = 500_000
SCHEMA = "key long, n long, class binary, tiles array<long>, bits binary, folded array<long>"


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        code = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = code
        return code


def ngrams(t: bytes, size: int, words: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a UTF-8 text, A-Z lower-cased."""
    found = t.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(size, len(found))
    out = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def parity_bits(codes: np.ndarray, least: int = 256) -> bytes:
    """A bitmap, of about a bit per member and ``least`` bits at least, in which each member flips one bit."""
    size = max(least, 1 << (len(codes) - 1).bit_length()) if len(codes) else least
    counts = np.bincount((codes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int = 256) -> list[int]:
    """A parity bitmap folded to ``size`` bits, as numbers of 64 bits."""
    x = np.frombuffer(bits, np.uint8)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.int64).tolist()


def may_link(percent: int, size: int = 256) -> Callable[[str, str], Column]:
    """Whether two sets can link, by their sizes and bitmaps folded to ``size``; the bits that differ are at most their difference."""

    def may(a: str, b: str) -> Column:
        n = F.col(f"n{a}") + F.col(f"n{b}")
        bits = [F.bit_count(F.col(f"fold{i}{a}").bitwiseXOR(F.col(f"fold{i}{b}"))) for i in range(size // 64)]
        return reduce(Column.__add__, bits) <= n - 2 * F.ceil(percent * n / (100 + percent))

    return may


def most_overlap(a: int, b: int, bits_a: bytes, bits_b: bytes) -> int:
    """A bound of the intersection from above; the longer bitmap is folded to the shorter."""
    x, y = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (a + b - int(np.bitwise_count(x ^ y).sum())) // 2


def bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of the bands in which a set of size ``n`` is filed.

    Its own, and those where a larger set that links with it may lie.
    """
    low, out = 1, []
    while 100 * n >= percent * low:
        high = max(low + 1, math.ceil(low * max(BAND_RATIO, 100 / percent))) - 1
        if n <= high:
            out.append((low, high))
        low = high + 1
    return out


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ (codes >> np.uint64(29))


@cache
def parts_of(low: int, high: int, percent: int) -> tuple[int, int]:
    """(parts, spare) of a band: the most n-grams in which linked sets differ, 1, and the empty parts to expect."""
    most = 2 * high * (100 - percent) // (100 + percent)
    spare = 0
    while most:
        parts = most + 1 + spare
        empty = parts * math.exp(-low * percent / 100 / parts)
        # Where that takes too many parts, as with few n-grams, sets are rather dealt again.
        if low < 30 or empty + 2 * math.sqrt(empty) <= spare or spare > most // 3:
            return parts, spare
        spare += 1
    return 0, 0


def deal(codes: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a set.

    Of two sets of a band that link, all but k parts are equal. With k + 1 + spare parts
    that is more than ``spare``; if one of the sets has at most ``spare`` empty parts, an equal part is left
    that is not empty, and both are filed under it. If both have more, both are dealt again.
    """
    out = [np.zeros(0, np.uint64)]
    for low, high in bands(len(codes), percent):
        parts, spare = parts_of(low, high, percent)
        if not parts:
            continue  # Only equal sets link.
        for turn in range(DEALS):
            seed = np.uint64((low * DEALS + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
            mixed = _mixed(codes + seed)
            part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, _mixed(mixed))
            held = np.bincount(part, minlength=parts) > 0
            empty = parts - int(held.sum())
            if turn == DEALS - 1:
                held[:] = True
            at = np.flatnonzero(held)
            out.append(_mixed(sums[at] + _mixed(at.astype(np.uint64) + seed)))
            if empty <= spare:
                break
    return np.concatenate(out)


def sketches(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, key, n, class, tiles, bits, folded) of every row; key is a digest of the text, an empty set has class null."""

    def make():
        words = WordHashes()

        def work(given: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {c: given[c] for c in ("id", "key")} | {c: [] for c in ("n", "class", "tiles", "bits", "folded")}
            for t in given["text"]:
                codes = ngrams(t, size, words)
                n = len(codes)
                out["n"].append(n)
                out["class"].append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if n else None)
                out["tiles"].append(deal(codes, percent).view(np.int64))
                out["bits"].append(parity_bits(codes))
                out["folded"].append(folded(parity_bits(codes, FOLD_BITS), FOLD_BITS))
            return out

        return work

    kind = df.schema[id_col].dataType.simpleString()
    columns = {"id": F.col(f"`{id_col}`"), "key": text_key(text_col), "text": utf8(text_col)}
    return map_rows(df, columns, make, f"id {kind}, {SCHEMA}")


def _linked(pairs: DataFrame, sets: DataFrame, df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(a, b) of the candidate pairs that link: bitmaps first, then the arrays.

    ``pairs`` has classes a and b; ``sets`` has class, id, n and bits.
    """
    side = sets.select("class", "id", "n", "bits")
    rich = pairs
    for s in ("a", "b"):
        rich = rich.join(side.toDF(s, f"id_{s}", f"n_{s}", f"bits_{s}"), s)

    def bounded():
        def work(given: dict[str, list]) -> dict[str, list]:
            rows = zip(given["n_a"], given["n_b"], given["bits_a"], given["bits_b"], strict=True)
            fine = [most_overlap(a, b, x, y) >= least_overlap(a, b, percent) for a, b, x, y in rows]
            return {k: given[k] for k in ("a", "b", "id_a", "id_b")} | {"fine": fine}

        return work

    kind = df.schema[id_col].dataType.simpleString()
    columns = {c: F.col(c) for c in rich.columns}
    kept = map_rows(rich, columns, bounded, f"a binary, b binary, id_a {kind}, id_b {kind}, fine boolean")
    kept = stored(kept.filter("fine").drop("fine"), "ngram-pairs")
    ids = kept.select(F.col("id_a").alias("id")).union(kept.select("id_b")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(ids, F.col("doc").eqNullSafe(F.col("id")), "left_semi")

    def arrays():
        words = WordHashes()

        def work(given: dict[str, list]) -> dict[str, list]:
            codes = [ngrams(t, size, words) for t in given["text"]]
            named = [hashlib.blake2b(c.tobytes(), digest_size=16).digest() for c in codes]
            return {"class": named, "codes": [c.tobytes() for c in codes]}

        return work

    codes = map_rows(texts, {"text": utf8("text")}, arrays, "class binary, codes binary").dropDuplicates(["class"])
    full = kept.select("a", "b")
    for s in ("a", "b"):
        full = full.join(codes.toDF(s, f"codes_{s}"), s)

    def exact():
        def work(given: dict[str, list]) -> dict[str, list]:
            fine = []
            for x, y in zip(given["codes_a"], given["codes_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * both >= percent * (len(x) + len(y) - both))
            return {"a": given["a"], "b": given["b"], "fine": fine}

        return work

    checked = map_rows(full, {c: F.col(c) for c in full.columns}, exact, "a binary, b binary, fine boolean")
    return stored(checked.filter("fine").drop("fine"), "ngram-links")


def classes(
    df: DataFrame, id_col: str, text_col: str, size: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, class) of every row, and (class, id, component, component_id) of every class.

    ``component`` is the class that stands for the component, ``component_id`` the smallest id in it.
    """
    every = stored(sketches(df, id_col, text_col, size, percent), "ngram-sketches")
    sets = stored(
        every.filter("n > 0").groupBy("class").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bits", "folded")]),
        "ngram-sets",
    )
    filed = every.select(F.col("class").alias("node"), F.explode("tiles").alias("tile"))
    side = sets.select(F.col("class").alias("node"), "n", *[F.col("folded")[i].alias(f"fold{i}") for i in range(FOLD_BITS // 64)])
    roots = linked_groups(
        filed, lambda pairs: _linked(pairs, sets, df, id_col, text_col, size, percent), side, may_link(percent, FOLD_BITS)
    )
    named = sets.select("class", "id").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("root", "class")).drop("root")
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    found = stored(named.join(smallest, "component").select("class", "id", "component", "component_id"), "ngram-classes")
    rows = stored(every.select("id", "key", "n", "class"), "ngram-rows")
    discard(every, sets, roots)
    return rows, found


def groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    percent: int = 85,
) -> DataFrame:
    """(id, n, component_id): the size of each row's set and the smallest id reachable by links."""
    rows, found = classes(df, id_col, text_col, size, percent)
    out = rows.join(found.select("class", "component_id"), "class", "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """``df`` with one row of each connected group: that of the smallest id, and of its texts the least by digest.

    Texts of one id in different groups stay apart; repeated rows stay once. Rows without an id, or without words, stay.
    """
    rows, found = classes(df, id_col, text_col, size, percent)
    named = rows.filter("id IS NOT NULL AND n > 0").join(found.select("class", "component"), "class")
    first = named.groupBy("component").agg(F.min(F.struct("id", "key")).alias("first"))
    gone = named.join(first, "component").filter(F.struct("id", "key") != F.col("first"))
    gone = stored(gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "ngram-gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    key = text_key(text_col)
    left = df.join(gone, (F.col(f"`{id_col}`") == F.col("gone_id")) & (key == F.col("gone_key")), "left_anti")
    again = rows.filter("id IS NOT NULL").groupBy("id", "key").count().filter("count > 1")
    again = again.select(F.col("id").alias("again"), F.col("key").alias("again_key"))
    if again.isEmpty():
        return left
    same = (F.col(f"`{id_col}`") == F.col("again")) & (key == F.col("again_key"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
