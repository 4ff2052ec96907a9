"""Byte-pair encoding by speculation: greedy tokens, a test of every adjacent pair, exact merging on failure.

A sequence of tokens is what merging would give exactly when every token encodes
to itself and every two neighbours, joined, encode to themselves again. So the
longest vocabulary entries are taken greedily, all neighbouring pairs of a batch
are tested at once with array operations, and only words with a failing pair are
merged in the ordinary way.

Nulls count as empty text; empty texts have no tokens; a text of any length is
encoded whole (merging is O(n log n) in a word). Repeated rows stay as they are,
an empty table gives an empty result, and only the named columns are read, so
other columns may have any names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm.common import small_batches, text

# Entries of the word cache of one worker before it is renewed.
CACHE_WORDS = 400_000
# Words of at most so many bytes are merged by scanning.
SHORT_WORD = 32
# Below this code point the splitting pattern classifies characters alike in all libraries.
_SAFE_BELOW = "԰"
# The public splitting pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_AFTER_SPACE = re.compile(r" \s")


def byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, the pair each was merged from, and when (its rank; -1 for bytes)."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        size = max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.size, self.letters = size, letters
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_ids = frozenset(self.specials.values())
        self.surface: list[bytes] = [b""] * size
        for token, i in ids.items():
            if i not in self.special_ids:
                self.surface[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.surface[i] = token.encode()
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.empty(len(merges), np.int64)
        self.merge: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            keys[r] = x * size + y
            self.merge[x * size + y] = (r, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.pair_order = np.argsort(keys)
        self.pair_keys = keys[self.pair_order]
        self.bytes_id = {self.surface[i][0]: i for i in ids.values() if len(self.surface[i]) == 1}
        self._greedy_tokens(ids)
        self.split = regex.compile(PATTERN)
        self.special_split = (
            re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        )
        self.presplit = Tokenizer.from_file(path).pre_tokenizer

    def _greedy_tokens(self, ids: dict[str, int]) -> None:
        """Tokens that encode to themselves, and their lengths by the first two bytes."""
        made = [i for i in ids.values() if self.rank[i] >= 0 and i not in self.special_ids]
        made.sort(key=lambda i: self.rank[i])
        made_ids = np.array(made, np.int64)
        apart = self.compatible(self.left[made_ids], self.right[made_ids], self.rank[made_ids])
        sound = np.ones(self.size, bool)
        for i, ok in zip(made, apart, strict=True):
            sound[i] = ok and sound[self.left[i]] and sound[self.right[i]]
        self.by_bytes = {
            self.surface[i]: i for i in ids.values() if sound[i] and i not in self.special_ids
        }
        sizes: dict[bytes, set[int]] = {}
        for token in self.by_bytes:
            sizes.setdefault(token[:2], set()).add(len(token))
        self.sizes = {start: tuple(sorted(n, reverse=True)) for start, n in sizes.items()}

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """When the pair merges; a huge number if never."""
        key = x * self.size + y
        if not len(self.pair_keys):
            return np.full(len(key), 1 << 60)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_order[at], 1 << 60)

    def compatible(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of x and y, for many pairs at once.

        The merges on both sides are undone newest first. At each point the two
        tokens at the border must not merge earlier than the step undone last.
        Of two merges of one kind the left one comes first. ``until``: ignore
        what would happen from that rank on.
        """
        fine = np.ones(len(x), bool)
        where = np.arange(len(x))
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), 1 << 59) if until is None else until.copy()
        while len(where):
            clash = self.pair_rank(x, y) < limit
            fine[where[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ((rx >= 0) | (ry >= 0))
            undo_left = rx > ry
            limit = np.where(undo_left, rx, ry + 1)[go]
            x, y = np.where(undo_left, self.right[x], x)[go], np.where(undo_left, y, self.left[y])[go]
            where = where[go]
        return fine

    def greedy(self, word: bytes) -> list[int]:
        get, sizes, out, at, n = self.by_bytes.get, self.sizes.get, [], 0, len(word)
        while at < n:
            for size in sizes(word[at : at + 2], ()):
                token = get(word[at : at + size]) if at + size <= n else None
                if token is not None:
                    break
            else:
                size, token = 1, self.bytes_id[word[at]]
            out.append(token)
            at += size
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: a scan for the first pair in short words, a heap over a linked list in long ones."""
        ids = [self.bytes_id[b] for b in word]
        if len(ids) <= SHORT_WORD:
            return self._merged_short(ids)
        n, V, merge = len(ids), self.size, self.merge
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []
        for i in range(n - 1):
            found = merge.get(ids[i] * V + ids[i + 1])
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            for p, q in ((before[i], i), (i, k)):
                if p >= 0 and q >= 0:
                    found = merge.get(ids[p] * V + ids[q])
                    if found:
                        heapq.heappush(heap, (found[0], p, ids[p], ids[q], found[1]))
        return [i for i in ids if i >= 0]

    def _merged_short(self, ids: list[int]) -> list[int]:
        V, get, never = self.size, self.merge.get, (1 << 60, -1)
        pairs = [get(a * V + b, never) for a, b in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is never:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] * V + ids[i], never)
            if i < len(pairs):
                pairs[i] = get(ids[i] * V + ids[i + 1], never)
        return ids


class Encoder:
    """Encodes batches of texts; words already met come from a bounded cache."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.failed = self.seen = 0

    def _split(self, part: str) -> list[bytes]:
        v = self.vocab
        if part.isascii() or max(part) < _SAFE_BELOW:
            return [p.encode() for p in v.split.findall(part)]
        return [bytes(v.letters[c] for c in p) for p, _ in v.presplit.pre_tokenize_str(part)]

    def _learn(self, pieces: set[bytes]) -> None:
        """Speculate on all new pieces, verify every pair, merge what failed."""
        new = list(pieces)
        guess = [self.vocab.greedy(p) for p in new]
        flat = np.array([t for g in guess for t in g], np.int64)
        owner = np.repeat(np.arange(len(new)), [len(g) for g in guess])
        inside = owner[1:] == owner[:-1]
        fine = self.vocab.compatible(flat[:-1][inside], flat[1:][inside])
        wrong = set(owner[1:][inside][~fine].tolist())
        self.seen += len(new)
        self.failed += len(wrong)
        for i in wrong:
            guess[i] = self.vocab.merged(new[i])
        data = np.array([t for g in guess for t in g], "<u4").tobytes()
        at = 0
        for piece, ids in zip(new, guess, strict=True):
            self.pieces[piece] = data[at : (at := at + 4 * len(ids))]

    def _words(self, part: str) -> list[str]:
        """Cut at the spaces, which go with the word after them, if none is part of a longer run."""
        if part[0] == " " or part[-1] == " " or _AFTER_SPACE.search(part):
            return [part]
        first, *rest = part.split(" ")
        return [first, *[" " + w for w in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        special = self.vocab.special_split
        specials = {s: np.array([i], "<u4").tobytes() for s, i in self.vocab.specials.items()}
        cut: list[list[str]] = []
        for t in texts:
            parts = special.split(t) if special and any(s in t for s in specials) else [t]
            words: list[str] = []
            for p in parts:
                if p in specials:
                    words.append(p)
                elif p:
                    words.extend(self._words(p))
            cut.append(words)
        if len(self.words) > CACHE_WORDS:
            self.old, self.words = self.words, {}
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {}
        known = self.words
        new = set().union(*cut) - known.keys()
        kept = {w: self.old[w] for w in new if w in self.old}
        known.update(kept)
        new.difference_update(kept)
        split = {w: self._split(w) for w in new if w not in specials}
        unknown = {p for pieces in split.values() for p in pieces if p not in self.pieces}
        if unknown:
            self._learn(unknown)
        found = self.pieces.__getitem__
        # Words longer than any natural one are used once and not kept.
        extra = {w: b"".join(map(found, pieces)) for w, pieces in split.items()} | specials
        get = known.__getitem__
        known.update((w, b) for w, b in extra.items() if len(w) <= 64)
        out = []
        for words in cut:
            try:
                out.append(b"".join(map(get, words)))
            except KeyError:
                out.append(b"".join([known[w] if w in known else extra[w] for w in words]))
        for p in [p for p in unknown if len(p) > 64]:
            del self.pieces[p]
        return out

    def decode(self, ids: np.ndarray, skip_special_tokens: bool = False) -> str:
        surface, special = self.vocab.surface, self.vocab.special_ids
        tokens = ids.tolist()
        if skip_special_tokens:
            tokens = [t for t in tokens if t not in special]
        return b"".join(map(surface.__getitem__, tokens)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True
) -> DataFrame:
    """(id, ids array<int>, decoded): the tokens of every whole text and, if asked, their text again.

    ``vocabulary`` is the path of a byte-level vocabulary file that every
    executor can open. No shuffle; one row per input row.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            rows = tool.encode(batch.column(1).to_pylist())
            flat = np.frombuffer(b"".join(rows), "<i4")
            ends = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            columns, names = [batch.column(0), ids], ["id", "ids"]
            if decode:
                back = [tool.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                columns.append(pa.array(back, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(df[f"`{id_col}`"].alias("id"), text(text_col).alias("text"))
    schema = f"id {kind}, ids array<int>" + (", decoded string" if decode else "")
    return rows.mapInArrow(run, schema)
