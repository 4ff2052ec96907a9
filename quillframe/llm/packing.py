"""Pack tokenised documents into sequences of one length with minimum bin slack.

Each task packs its own documents, so nothing is shuffled. A document is first
cut into full windows; what remains of it is a piece shorter than a window. From
the pieces at hand the longest is placed, and a subset-sum over the multiset of
the remaining lengths, kept as one bitset per distinct length, finds the choice
that comes closest to filling the window; walking back through the bitsets gives
how many pieces of each length it takes. The same choice is used again as often
as the counts allow. A window that no choice fills takes a cut from one more
piece. Only the end of a task is shorter than a window: it is cut at powers of
two, which need no padding.

Nulls count as empty text, an empty document still has its end id, a document of
any length is packed whole, equal rows are separate documents, an empty table
gives no pieces, and other columns may have any names.
"""

from __future__ import annotations

import string
import struct
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm.common import small_batches, utf8

# Entries of one worker's word cache, and the longest word it keeps.
CACHE_WORDS, CACHED_WORD = 600_000, 64
# Marks that end a word, each by itself or in a run.
PUNCTUATION = string.punctuation.encode()
# Texts with one of these keep their case until the library has seen them: the beginning of a special
# token, and of the marks that a small letter can join with where its capital cannot.
AS_IT_IS = (b"<|", b"\xcc", b"\xcd")
# Letters below this code point are letters in every version of Unicode in use.
LETTERS_BELOW = "\u0250"
# Pieces and bytes of ids at hand when windows are filled; the rest waits for more.
POOL_PIECES, POOL_BYTES = 4096, 32 << 20
KEEP_PIECES = 256


def byte_letters() -> dict[int, str]:
    """The visible character by which byte-level vocabularies write each byte."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


WRITTEN = byte_letters()


class Words(dict):
    """Ids of words, learned at their first look-up.

    Letters and the punctuation after them are always split, and a run of letters goes
    to the library's merges as a whole. So words of plain letters need no splitting,
    and those with other endings are learned once.
    """

    def __init__(self, tool: WordTokens, old: dict[bytes, bytes], tails: dict[bytes, bytes]):
        self.tool, self.old, self.tails = tool, old, tails

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            stem = word.rstrip(PUNCTUATION)
            written = plain_letters(stem)
            if written is None:
                ids = self.tool.whole(word)
            elif len(stem) == len(word):
                tokens = self.tool.merges(written)
                ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            else:
                ids = self[stem] + self._tail(word[len(stem) :])
        if len(word) <= CACHED_WORD:
            self[word] = ids
        return ids

    def _tail(self, tail: bytes) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self.tool.whole(tail)
            if len(tail) <= 3:
                self.tails[tail] = ids
        return ids


def plain_letters(stem: bytes) -> str | None:
    """A stem of plain letters as a byte-level vocabulary writes it, in lower case."""
    if stem.isalpha():
        return stem.lower().decode()
    t = stem.decode("utf-8", "replace")
    if t.isalpha() and max(t) < LETTERS_BELOW and t.lower().isalpha():
        return t.lower().encode().decode("latin-1").translate(WRITTEN)
    return None


class WordTokens:
    """Ids of whole texts by the tokenizers library, word by word.

    The vocabulary drops white space and the case of letters, and its splitting never
    looks across white space, so the ids of a text are those of its words in lower
    case, one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.merges = self.tool.model.tokenize
        self.known = Words(self, {}, {})

    def whole(self, word: bytes) -> bytes:
        """Ids of a text by all steps of the library."""
        (found,) = self.tool.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if len(self.known) > CACHE_WORDS:
            self.known = Words(self, dict(self.known), self.known.tails)
        found = self.known.__getitem__
        return [
            b"".join(map(found, (t if any(mark in t for mark in AS_IT_IS) else t.lower()).split())) for t in texts
        ]


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest sum of at most ``capacity``.

    Bit s of a layer says that the lengths so far can sum to s. Lengths are added
    from the longest on, in doubling multiples, until the capacity is reached.
    """
    full, reach = (1 << (capacity + 1)) - 1, 1
    layers: list[tuple[int, int]] = []
    for length in sorted((n for n in counts if n <= capacity), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (take * length)) & full
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            taken[length] = n
    return taken


class Packer:
    """Fills sequences of ``capacity``; gives pieces as (document, start, ids, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int = 0):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, deque] = defaultdict(deque)
        self.count = self.held = 0
        self.lengths: list[int] = []

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """Full windows at once; the remainder joins the pool."""
        size, cap = len(ids) // 4, self.capacity
        whole = size - size % cap
        for start in range(0, whole, cap):
            yield (doc, start, ids[4 * start : 4 * (start + cap)], self._next(), 0)
        if size > whole:
            self._put((doc, whole, ids[4 * whole :]))
        if self.count >= POOL_PIECES or self.held >= POOL_BYTES:
            yield from self._fill(KEEP_PIECES)

    def finish(self) -> Iterator[tuple]:
        """All that is left: full windows, then powers of two."""
        yield from self._fill(0)
        rest = [self.pool[n].popleft() for n in sorted(self.pool, reverse=True) for _ in range(len(self.pool[n]))]
        left, self.count, self.held = sum(len(p[2]) // 4 for p in rest), 0, 0
        self.pool.clear()
        room = offset = 0
        for doc, start, ids in rest:
            at = 0
            while at < len(ids) // 4:
                if not room:
                    room, offset, sequence = 1 << (left.bit_length() - 1), 0, self._next()
                n = min(room, len(ids) // 4 - at)
                yield (doc, start + at, ids[4 * at : 4 * (at + n)], sequence, offset)
                at, room, offset, left = at + n, room - n, offset + n, left - n

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _put(self, piece: tuple) -> None:
        self.pool[len(piece[2]) // 4].append(piece)
        self.count += 1
        self.held += len(piece[2])

    def _take(self, length: int) -> tuple:
        queue = self.pool[length]
        piece = queue.popleft()
        if not queue:
            del self.pool[length]
        self.count -= 1
        self.held -= len(piece[2])
        return piece

    def _fill(self, keep: int) -> Iterator[tuple]:
        cap = self.capacity
        while self.count > keep and self.held >= 4 * cap:
            counts = {n: len(q) for n, q in self.pool.items()}
            longest = max(counts)
            counts[longest] -= 1
            taken = closest_fill({n: c for n, c in counts.items() if c}, cap - longest)
            taken[longest] = taken.get(longest, 0) + 1
            slack = cap - sum(n * c for n, c in taken.items())
            again = 1 if slack else min(len(self.pool[n]) // c for n, c in taken.items())
            for _ in range(again):
                sequence, offset = self._next(), 0
                for n, c in taken.items():
                    for _ in range(c):
                        doc, start, ids = self._take(n)
                        yield (doc, start, ids, sequence, offset)
                        offset += n
                while offset < cap:  # no choice fills it: cut the longest piece that is left
                    doc, start, ids = self._take(max(self.pool))
                    n = min(cap - offset, len(ids) // 4)
                    yield (doc, start, ids[: 4 * n], sequence, offset)
                    offset += n
                    if len(ids) > 4 * n:
                        self._put((doc, start + n, ids[4 * n :]))


_TOKENS: dict[str, WordTokens] = {}


def pack(
    df: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row per piece.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    Every document ends with ``end_id``. ``vocabulary`` is the path of a word
    vocabulary that every executor can open. ``capacity`` is a power of two.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        if vocabulary not in _TOKENS:
            _TOKENS[vocabulary] = WordTokens(vocabulary)
        tool = _TOKENS[vocabulary]
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        kinds = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = [
                [p[0][0] for p in pieces], [p[1] for p in pieces], [len(p[2]) // 4 for p in pieces],
                [p[2] for p in pieces], [p[0][1] for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces],
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        done: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tool.ids(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece in packer.add((doc, len(ids) // 4), ids):
                    done.append(piece)
                    size += len(piece[2])
                    if size > POOL_BYTES // 4:
                        yield rows(done)
                        done, size = [], 0
        for piece in packer.finish():
            done.append(piece)
            size += len(piece[2])
            if size > POOL_BYTES // 4:
                yield rows(done)
                done, size = [], 0
        if done:
            yield rows(done)

    schema = (
        f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )
    return df.select(df[f"`{id_col}`"].alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, schema)
