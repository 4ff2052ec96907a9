"""Keep one occurrence of each line, and of lines that are nearly alike, over the whole table.

1. Lines are normalised: lower case, digits alike, words only. Lines with the same words are one.
2. Near lines have an edit similarity of ``similarity`` or more, in words. Each line gets a SimHash in
   blocks: its words are dealt to blocks by their hashes, and a block is the 64-bit SimHash of
   the words dealt to it. An edit touches two blocks at most, so by pigeonhole lines with few edits have
   whole blocks in common. There are several deals, of some eight words a block;
   the number of blocks is that of a band of line lengths, and a line is filed under its blocks in its own
   band and in those where longer partners may lie. Words that many of all lines hold, by a count over
   the whole table, only count in blocks of fewer than ``MIN_BLOCK`` other words, each occurrence as a word of its own. So every
   line that is long enough for an edit is filed in every deal, whatever its words; what is not filed are single blocks
   of fewer than ``MIN_BLOCK`` words in all.
3. `tiles.linked_groups` compares the lines filed under the same block and finds connected
   groups. Candidates whose SimHashes of the whole line differ in more than ``MAX_BITS`` of 64 bits, or
   whose lengths differ too much, are dropped; of the others the edit similarity is computed. Lines of one form
   share blocks in great number: where they are still apart, they are dealt again by their rarest words.
4. Of each connected group the first occurrence stays (by document id, then text, then line).

The block scheme is a sieve: a pair at the very limit of the similarity is missed now and then (README
has the recall by length, measured against all pairs), a pair within half of it hardly ever. Lines too short for
one edit are alike only if they are equal. Equal lines are always found.

Blank lines always stay; every other line goes where an equal one came before, however short. Lines without
words are equal if their characters are. In scripts without spaces each character is a word. Null texts
stay null, texts are read whole, an empty table stays empty. Rows equal in id and
text count as one document, in which the same lines go. Other columns are
returned as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import discard, map_rows, small_batches, stored, text_key, utf8
from quillframe.llm.ngram_join import BROADCAST_IDS
from quillframe.llm.tiles import linked_groups

SIMILARITY, MAX_BITS = 0.9, 20
# By the length of a band's shortest line: how often words are dealt, and to blocks of how many of them.
DEALS = ((0, 7, 8), (15, 4, 6), (20, 3, 8), (30, 2, 8), (50, 1, 7), (100, 1, 10), (250, 1, 14))
# In a block of fewer other words, common words count too; a block of fewer words in all is not filed.
MIN_BLOCK = 3
BAND_RATIO = 1.5
# Common words are those that more than this share of all lines hold.
COMMON_SHARE = 0.01
# Texts of about so many bytes are taken apart at once.
CHUNK_BYTES = 1 << 20
# Words are counted by the upper bits of their hashes; the lower ones then number the lines of a chunk.
_LINE_BITS = np.uint64(20)
# A task hands on its counts of words when it holds so many.
HELD_WORDS = 500_000
# Lower case, digits alike, marks as spaces; line feeds and bytes beyond ASCII stay.
_PLAIN = bytes(
    10 if c == 10 else 48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
    for c in range(256)
)
# Scripts without spaces, as UTF-8: Thai, Lao, Myanmar, Khmer, kana, Han. Their punctuation is U+3000 to U+303F.
_UNSPACED_MARKS = re.compile(rb"\xe3\x80[\x80-\xbf]|\xef\xbc[\x81-\x8f\x9a-\xa0]|\xef\xbd[\x9b-\xa4]")
_UNSPACED = re.compile(
    rb"((?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xe2[\xba-\xbf]|[\xe3-\xe9][\x80-\xbf]|\xef[\xa4-\xab]|\xf0[\xa0-\xaf][\x80-\xbf])[\x80-\xbf])"
)
_MAY_BE_UNSPACED = re.compile(rb"[\xe0-\xe9\xef\xf0]")


def _mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return codes ^ (codes >> np.uint64(29))


# A number for each byte.
_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)))


def _placed(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each byte at its place in a word."""
    return _mixed(_BYTES[chars] + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# The same for the first places, summed up for two bytes at once; a mark or line feed after a word adds nothing.
_PLACES = 32
_PLACED = _placed(np.tile(np.arange(256), _PLACES), np.repeat(np.arange(_PLACES), 256)).reshape(-1, 2, 1, 256)
_PAIRS = (np.where(np.arange(256) > 32, _PLACED[:, 1], 0).reshape(-1, 256, 1) + _PLACED[:, 0]).reshape(-1, 1 << 16)


def _plain(t: bytes) -> bytes:
    """A text as words between spaces and line feeds; in scripts without spaces each character is a word."""
    if not t.isascii() and _MAY_BE_UNSPACED.search(t):
        t = _UNSPACED.sub(rb" \1 ", _UNSPACED_MARKS.sub(b" ", t))
    return t.translate(_PLAIN)


def coded_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, number of words in each line) of all lines of the texts.

    A word's hash mixes the sum of hashes of its bytes with their places, so words are neither cut out nor looked up.
    """
    joined = b"\n%b\n" % b"\n".join(map(_plain, texts))
    marks = np.frombuffer(joined, np.uint8)
    inner = marks > 32
    edges = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    breaks = np.flatnonzero(marks == 10)
    sizes = np.diff(np.searchsorted(begins, breaks))
    # Two bytes at each place, and the sum over the places of each word.
    twos = marks[:-1] | marks[1:].astype(np.uint16) << 8
    sums = _PAIRS[0].take(twos.take(begins))
    left = np.arange(len(begins))
    for i in range(1, len(_PAIRS)):
        left = left[lengths.take(left) > 2 * i]
        if not len(left):
            break
        sums[left] += _PAIRS[i].take(twos.take(begins.take(left) + 2 * i))
    far = left[lengths.take(left) > _PLACES]
    if len(far):
        lengths = lengths[far] - _PLACES
        starts = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(starts, lengths) + _PLACES
        sums[far] += np.add.reduceat(_placed(marks[np.repeat(begins[far], lengths) + at], at), starts)
    return _mixed(_mixed(sums)), sizes


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in stretches of about ``CHUNK_BYTES``."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= CHUNK_BYTES:
            yield some
            some, held = [], 0
    if some:
        yield some


def line_words(line: bytes) -> list[bytes]:
    """The words of a normalised line; bytes beyond ASCII are parts of words."""
    return _plain(line).split()


def edit_distance(a: list[bytes], b: list[bytes]) -> int:
    """Fewest insertions, deletions and replacements of words, by columns kept as bit vectors.

    Words that both begin or end with cost nothing, so only what is left between them is compared.
    """
    head, least = 0, min(len(a), len(b))
    while head < least and a[head] == b[head]:
        head += 1
    tail, least = 0, least - head
    while tail < least and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    n = len(a)
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    mask, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    for w in b:
        equal = where.get(w, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        more = down | (~(diagonal | up) & mask)
        less = up & diagonal
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more = (more << 1 | 1) & mask
        less = (less << 1) & mask
        up = less | (~(diagonal | more) & mask)
        down = more & diagonal
    return score


def are_near(
    a: list[bytes], b: list[bytes], similarity: float, of_a: set[bytes] | None = None, of_b: set[bytes] | None = None
) -> bool:
    """Whether the edit similarity is reached; words that the other line does not hold count against it first.

    ``of_a`` and ``of_b`` are the sets of the words, where the caller has them.
    """
    longest = max(len(a), len(b))
    least = similarity * longest - 1e-9
    of_a, of_b = set(a) if of_a is None else of_a, set(b) if of_b is None else of_b
    if sum(map(of_b.__contains__, a)) < least or sum(map(of_a.__contains__, b)) < least:
        return False
    return longest - edit_distance(a, b) >= least


def words_digest(codes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(codes.tobytes()) - (1 << 63)


def lines_holding(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes without the lowest bits, number of lines that hold them), for lines given as stretches of hashes."""
    heads, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sizes = sizes[sizes > 0]
    ends = np.cumsum(sizes)
    for first in range(0, len(sizes), 1 << int(_LINE_BITS)):
        some = sizes[first : first + (1 << int(_LINE_BITS))]
        part = codes[ends[first] - sizes[first] : ends[first + len(some) - 1]]
        held = (part >> _LINE_BITS << _LINE_BITS) | np.repeat(np.arange(len(some), dtype=np.uint64), some)
        held.sort()
        held = held[np.append(True, held[1:] != held[:-1])] >> _LINE_BITS << _LINE_BITS
        starts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        heads.append(held[starts])
        counts.append(np.diff(np.append(starts, len(held))))
    return np.concatenate(heads), np.concatenate(counts)


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(code, held, often): how many lines of a stretch of rows hold a word, and whether that is more than the share.

    Every line of every row counts. The number of lines goes under no word. A task hands on each word once, or
    once for each ``HELD_WORDS`` counts.
    """

    def summed(parts: list[tuple[np.ndarray, np.ndarray]], lines: int) -> pa.RecordBatch:
        codes, held = [np.concatenate([p[i] for p in parts]) for i in range(2)]
        order = np.argsort(codes)
        codes, held = codes[order], held[order]
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        held = np.add.reduceat(held, starts) if len(starts) else held
        no_word = np.append(True, np.zeros(len(starts), bool))
        code = pa.array(np.append(0, codes[starts].view(np.int64)), mask=no_word)
        often = pa.array(np.append(False, held > COMMON_SHARE * lines))
        return pa.RecordBatch.from_arrays([code, pa.array(np.append(lines, held)), often], ["code", "held", "often"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, lines, n = [], 0, 0
        for batch in batches:
            for some in chunks(batch.column(0).to_pylist()):
                codes, sizes = coded_lines(some)
                parts.append(lines_holding(codes, sizes))
                lines += int((sizes > 0).sum())
                n += len(parts[-1][0])
                if n >= HELD_WORDS:
                    yield summed(parts, lines)
                    parts, lines, n = [], 0, 0
        if parts:
            yield summed(parts, lines)

    small_batches(df.sparkSession)
    return df.select(utf8(text_col).alias("text")).mapInArrow(count, "code long, held long, often boolean")


def common_words(df: DataFrame, text_col: str) -> np.ndarray:
    """Hashes, without the lowest bits, of the words that many of all lines hold; in most blocks others count alone.

    Every line of every row counts. What is above the share in all lines is so in a stretch of them at least, so
    counts are added up for the words of which that is true. More than ``1 / COMMON_SHARE`` times the words of a
    mean line cannot come out.
    """
    held = stored(word_counts(df, text_col), "line-words")
    often = stored(held.filter("often OR code IS NULL").groupBy("code").agg(F.sum("held").alias("held")), "line-often")
    lines = often.filter("code IS NULL").agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]
    some = often.filter("code IS NOT NULL").select("code")
    if some.count() <= BROADCAST_IDS:
        some = F.broadcast(some)
    common = held.join(some, "code", "left_semi").groupBy("code").agg(F.sum("held").alias("held"))
    common = common.filter(F.col("held") > COMMON_SHARE * lines)
    found = np.sort(np.array([r["code"] for r in common.collect()], np.int64).view(np.uint64))
    discard(held, often)
    return found


def _among(codes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the sorted ``common``, by their upper bits."""
    if not len(common):
        return np.zeros(len(codes), bool)
    # Looked up by their first 16 bits, with which few of ``common`` begin.
    heads, known = codes >> _LINE_BITS, common >> _LINE_BITS
    often = np.bincount((common >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    at = (np.cumsum(often) - often).take(codes >> np.uint64(48))
    found = np.zeros(len(codes), bool)
    for i in range(int(often.max())):
        found |= known.take(at + i, mode="clip") == heads
    return found


def simhashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One SimHash for each stretch of hashes; each bit is the majority of theirs.

    Bits are counted in bytes, eight to a 64-bit sum, over at most 255 hashes at once.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(codes)))
    pieces = -(-sizes // 255)
    heads = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts - 255 * heads, pieces) + 255 * np.arange(int(pieces.sum()))
    ends = np.append(cuts[1:], len(codes))
    ones = np.empty((len(cuts), 64), np.uint8)
    first = 0
    while first < len(cuts):
        last = max(first + 1, int(np.searchsorted(ends, cuts[first] + (1 << 14), "right")))
        part = codes[cuts[first] : ends[last - 1]]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        ones[first:last] = np.add.reduceat(bits, cuts[first:last] - cuts[first], axis=0).view(np.uint8)
        first = last
    most = ones[heads] > np.minimum(sizes // 2, 255)[:, None].astype(np.uint8)
    for i in np.flatnonzero(pieces > 1):
        most[i] = 2 * ones[heads[i] : heads[i] + pieces[i]].sum(axis=0, dtype=np.int64) > sizes[i]
    return np.packbits(most, axis=1).view(np.uint64).ravel()


def bands(longest: int, similarity: float) -> list[tuple[int, int]]:
    """(lowest, highest) length of each band up to ``longest``; the first holds the shortest lines one edit keeps near."""
    if similarity >= 1:
        return []
    low, out = math.ceil(1 / (1 - similarity) - 1e-9), []
    while similarity * low <= longest + 1e-9:
        high = max(low + 1, math.ceil(low * max(BAND_RATIO, 1 / similarity))) - 1
        out.append((low, high))
        low = high + 1
    return out


def _repeats_apart(codes: np.ndarray, owner: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The hashes with another one for a line's second, third, ... occurrence of a word, of those that ``which`` has.

    Else a block in which one word is most frequent would have the SimHash of that word alone.
    """
    at = np.flatnonzero(which)
    pairs = codes[at] + _mixed(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(pairs)
    pairs = pairs.take(order)
    starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    nth = np.arange(len(pairs)) - np.repeat(starts, np.diff(np.append(starts, len(pairs))))
    out = codes.copy()
    out[at.take(order)] += nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return out


def line_keys(codes: np.ndarray, sizes: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(line numbers, keys) of lines given as stretches of word hashes.

    Every line that may have a near partner is filed, in each deal, as its fullest block has ``least`` words or more.
    """
    # Words in the order of their lines' sizes, so that those of a band are a stretch.
    by_size = np.argsort(sizes, kind="stable")
    counts = sizes[by_size]
    cuts = np.append(0, np.cumsum(counts))
    at = np.repeat((np.cumsum(sizes) - sizes)[by_size] - cuts[:-1], counts) + np.arange(cuts[-1])
    codes, owner = codes.take(at), np.repeat(np.arange(len(sizes)), counts)
    seldom = ~_among(codes, common)
    codes = _repeats_apart(codes, owner, ~seldom)
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low, high in bands(int(sizes.max(initial=0)), similarity):
        first = np.searchsorted(counts, similarity * low - 1e-9)
        last = np.searchsorted(counts, high, "right")
        words, whose, rare = [x[cuts[first] : cuts[last]] for x in (codes, owner, seldom)]
        if not len(words):
            continue
        deals, size = next(d[1:] for d in reversed(DEALS) if low >= d[0])
        blocks = max(2, round(low * 1.2 / size))
        least = max(1, min(MIN_BLOCK, int(similarity * low / blocks + 1e-9)))
        heads = (whose - first) * blocks
        for turn in range(deals):
            seed = np.uint64((low * 64 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
            mixed = _mixed(words + seed)
            block = (mixed >> np.uint64(32)).astype(np.uint32)
            block = heads + (block - block // np.uint32(blocks) * np.uint32(blocks))
            # Common words count where there are not enough others.
            few = np.bincount(block[rare], minlength=(last - first) * blocks) < MIN_BLOCK
            of_weight = np.flatnonzero(rare | few.take(block))
            block, mixed = block.take(of_weight), mixed.take(of_weight)
            order = np.argsort(block)
            block, mixed = block.take(order), _mixed(mixed.take(order))
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            held = np.diff(np.append(starts, len(block))) >= least
            names = block[starts]
            sims = simhashes(mixed, starts)
            key = _mixed(sims + _mixed((names % blocks).astype(np.uint64) + seed))
            lines.append(by_size[first + names[held] // blocks])
            keys.append(key[held])
    return np.concatenate(lines), np.concatenate(keys)


def occurrences(df: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(id, key, no, line, n, sim, keys) of every line that is not blank; n is its number of words."""
    common = common_words(df, text_col)

    def make():
        import xxhash

        def part(texts: list[bytes]) -> tuple[np.ndarray, ...]:
            """(lines of each text, line numbers, digests, sizes, SimHashes, number of keys, keys) of the lines that are not blank."""
            codes, sizes = coded_lines(texts)
            stops = np.cumsum(sizes)
            digests = np.zeros(len(sizes), np.int64)
            held = sizes > 0
            for i in np.flatnonzero(held):
                digests[i] = words_digest(codes[stops[i] - sizes[i] : stops[i]])
            per_text = np.array([t.count(b"\n") + 1 for t in texts])
            tops = np.cumsum(per_text) - per_text
            for t, top, n in zip(texts, tops, per_text, strict=True):
                without = np.flatnonzero(~held[top : top + n])
                if len(without) and not t.isspace():
                    parts = t.split(b"\n")
                    for no in without:
                        if line := parts[no].strip():
                            digests[top + no] = xxhash.xxh3_64_intdigest(line) - (1 << 63)
                            held[top + no] = True
            whose = np.repeat(np.arange(len(texts)), per_text)[held]
            nos = (np.arange(len(sizes)) - np.repeat(tops, per_text))[held]
            sizes, digests = sizes[held], digests[held]
            sims = np.zeros(len(sizes), np.uint64)
            some = sizes > 0
            sims[some] = simhashes(_mixed(codes), (np.cumsum(sizes) - sizes)[some])
            # Of equal lines one is filed.
            one = np.zeros(len(sizes), bool)
            one[np.unique(digests, return_index=True)[1]] = True
            owner, keys = line_keys(codes[np.repeat(one, sizes)], sizes[one], common, similarity)
            order = np.argsort(owner, kind="stable")
            n_keys = np.zeros(len(sizes), np.int64)
            n_keys[one] = np.bincount(owner, minlength=int(one.sum()))
            return np.bincount(whose, minlength=len(texts)), nos, digests, sizes, sims, n_keys, keys[order]

        def work(given: dict[str, list]) -> dict[str, Any]:
            parts = [part(some) for some in chunks(given["text"])]
            per_text, nos, lines, sizes, sims, n_keys, keys = map(np.concatenate, zip(*parts, strict=True))
            cut, each = [pa.array(np.append(0, np.cumsum(n)).astype(np.int32)) for n in (per_text, n_keys)]
            out = {
                "nos": pa.array(nos.astype(np.int32)),
                "lines": pa.array(lines),
                "sizes": pa.array(sizes.astype(np.int32)),
                "sims": pa.array(sims.view(np.int64)),
                "keyed": pa.ListArray.from_arrays(each, pa.array(keys.view(np.int64))),
            }
            return {"id": given["id"], "key": given["key"]} | {c: pa.ListArray.from_arrays(cut, v) for c, v in out.items()}

        return work

    kind = df.schema[id_col].dataType.simpleString()
    rows = map_rows(
        df,
        {"id": F.col(f"`{id_col}`"), "key": text_key(text_col), "text": utf8(text_col)},
        make,
        f"id {kind}, key long, nos array<int>, lines array<long>, sizes array<int>, sims array<long>, keyed array<array<long>>",
    )
    rows = rows.select("id", "key", F.inline(F.arrays_zip("nos", "lines", "sizes", "sims", "keyed")))
    return rows.toDF("id", "key", "no", "line", "n", "sim", "keys")


def _may(similarity: float):
    """Whether two lines can be near, by the lengths and the SimHashes of whole lines."""

    def may(a: str, b: str) -> Column:
        short, long = [f(F.col(f"n{a}"), F.col(f"n{b}")) for f in (F.least, F.greatest)]
        bits = F.bit_count(F.col(f"sim{a}").bitwiseXOR(F.col(f"sim{b}")))
        return (short >= F.lit(similarity) * long - 1e-9) & (bits <= MAX_BITS)

    return may


def _bodies(found: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(line, body) of the lines in question, from one occurrence each; only their texts are taken apart again.

    Of a line that is everywhere only the filed occurrences count, one a stretch of texts.
    """
    places = found.filter("filed").select("line", "id", "key", "no").join(nodes.toDF("line"), "line", "left_semi")
    places = places.groupBy("line").agg(F.min(F.struct("id", "key", "no")).alias("first"))
    places = stored(places.select("line", "first.*"), "line-places")
    few = places.count() <= BROADCAST_IDS
    per_doc = places.groupBy("id", "key").agg(F.collect_list(F.struct("no", "line")).alias("asked"))
    if few:
        per_doc = F.broadcast(per_doc)
    texts = df.select(F.col(f"`{id_col}`").alias("doc"), text_key(text_col).alias("doc_key"), F.col(f"`{text_col}`").alias("text"))
    parts = texts.join(per_doc, (F.col("doc_key") == F.col("key")) & F.col("doc").eqNullSafe(F.col("id")))
    parts = parts.select(F.split("text", "\n", -1).alias("parts"), F.explode("asked").alias("one"))
    bodies = parts.select(F.col("one.line").alias("line"), F.element_at("parts", F.col("one.no") + 1).alias("body"))
    bodies = stored(bodies.dropDuplicates(["line"]), "line-bodies")
    discard(places)
    return bodies


def _similar(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the candidate pairs whose words are similar."""
    both = pairs.join(bodies.toDF("a", "body_a"), "a").join(bodies.toDF("b", "body_b"), "b")

    def make():
        def work(given: dict[str, list]) -> dict[str, list]:
            words = {x: line_words(x) for x in {*given["body_a"], *given["body_b"]}}
            sets = {x: set(w) for x, w in words.items()}
            bodies = zip(given["body_a"], given["body_b"], strict=True)
            fine = [are_near(words[x], words[y], similarity, sets[x], sets[y]) for x, y in bodies]
            return {"a": given["a"], "b": given["b"], "fine": fine}

        return work

    columns = {"a": F.col("a"), "b": F.col("b"), "body_a": utf8("body_a"), "body_b": utf8("body_b")}
    checked = map_rows(both, columns, make, "a long, b long, fine boolean")
    return stored(checked.filter("fine").drop("fine"), "line-links")


def _rarest_words(nodes: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """(node, part): so many of a line's rarest words that lines with a similarity that is enough have one in common.

    Near lines share ``similarity`` of the words of either, a word counted as often as it occurs. In one order of all words,
    the first words of a line, one more than it may have for itself, then hold one of the other's first. Words are in the order of the
    number of ``nodes`` that hold them, so those that a form of many lines consists of come last.
    """
    rows = bodies.join(nodes.toDF("line"), "line", "left_semi")

    def make():
        def work(given: dict[str, list]) -> dict[str, Any]:
            codes, sizes = coded_lines(given["body"])
            cuts = np.append(0, np.cumsum(sizes)).astype(np.int32)
            codes = _repeats_apart(codes, np.repeat(np.arange(len(sizes)), sizes), np.ones(len(codes), bool))
            return {"node": given["line"], "words": pa.ListArray.from_arrays(pa.array(cuts), pa.array(codes.view(np.int64)))}

        return work

    words = map_rows(rows, {"line": F.col("line"), "body": utf8("body")}, make, "node long, words array<long>")
    words = stored(words.select("node", F.explode("words").alias("part")), "line-words")
    ranked = words.join(words.groupBy("part").count(), "part").groupBy("node")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("count", "part"))).alias("ranked"))
    shared = F.ceil(F.lit(similarity) * F.size("ranked") - 1e-9).cast("int")
    first = F.explode(F.slice("ranked", F.lit(1), F.size("ranked") - shared + 1)).alias("one")
    parts = stored(ranked.select("node", first).select("node", "one.part"), "line-parts")
    discard(words)
    return parts


def without_lines(text: list[str | None], gone: list[list[int] | None]) -> list[str | None]:
    """Texts without the lines of the given numbers."""
    out = []
    for t, numbers in zip(text, gone, strict=True):
        if t is not None and numbers is not None:
            left = set(numbers)
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in left)
        out.append(t)
    return out


def dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    report: bool = False,
) -> DataFrame:
    """``df`` with repeated lines taken out of its texts; with ``report`` (id, text, n_lines, n_removed)."""
    found = stored(occurrences(df, id_col, text_col, similarity).withColumn("filed", F.size("keys") > 0), "lines")
    filed = found.select(F.col("line").alias("node"), F.explode("keys").alias("tile"), "n", "sim")
    roots = linked_groups(
        filed, lambda pairs, bodies: _similar(pairs, bodies, similarity), may=_may(similarity),
        ready=lambda nodes: _bodies(found, nodes, df, id_col, text_col),
        parts=lambda nodes, bodies: _rarest_words(nodes, bodies, similarity),
    )
    # Lines that occur twice or more, or in a group: ``roots`` has all members of groups, and no others.
    often = found.groupBy("line").count().filter("count > 1").select("line")
    often = often.join(roots.toDF("line", "root"), "line", "full").select("line", F.coalesce("root", "line").alias("root"))
    again = stored(found.select("id", "key", "no", "line").join(often, "line").drop("line"), "line-again")
    kept = again.groupBy("root").agg(F.min(F.struct("id", "key", "no")).alias("kept"))
    same = F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("key") == F.col("kept.key")) & (F.col("no") == F.col("kept.no"))
    gone = again.join(kept, "root").filter(~same)
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).agg(F.collect_set("no").alias("gone"))
    gone = stored(gone, "lines-gone")
    discard(found, roots, again)

    body = F.col(f"`{text_col}`")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("key"), body.alias("text"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key")), "left")
    # Only texts that change are handed to Python.
    cut = F.pandas_udf(lambda t, g: pd.Series(without_lines(t.tolist(), g.tolist())), "string")
    rows = rows.withColumn("after", cut(F.when(F.col("gone").isNotNull(), F.col("text")), "gone"))
    after = F.coalesce("after", "text")
    if report:
        n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
        return rows.select(
            "id", after.alias("text"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        )
    return rows.select(*[after.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
