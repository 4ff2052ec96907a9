"""Repair the turn structure of conversations at the least cost, by depth-first branch and bound.

A row is kept (K, 0), gets the role of the other side (R, 3) or is deleted (D, 4); an empty turn
of user or assistant may be inserted anywhere (I, 3). Blank and repeated rows have to go; a
truncated row that stays adds 3. The roles' initials must then read (s?(ua)+)?. Of the
cheapest repairs the one whose letters, its audit, come first in ASCII order is taken. As at
every place of that pattern R and I can stand for one role only, the audit tells the repair.

A node of the search is (row, state of the pattern). An explicit stack holds prefixes; they are taken
in the order of their audits, so of equally cheap ways to a node the first one found is the
least. A prefix is dropped if its node's dominance table holds one no worse, or if its cost and
the lower bound of the rows to come (the cheapest repair of these where a system turn may
stand anywhere and the end is free) exceed what the incumbent allows. The first incumbent is found
by diving along the bound.

A conversation may hold a third of all rows. So rows are sorted by ranges of (conversation, turn, role,
digest of the text), without texts, and cut into segments of at most ``SEGMENT_ROWS`` rows. The search
runs from each state in which a segment may begin to each in which it may end; the segments' answers,
short strings, are joined in order, the least kept for each state. Texts are shuffled once, to the
task that digests the repaired conversation as a stream; a digest admits no other order.
Repeated rows are found by a grouped minimum, joined on unique keys.

Order of rows: turn (null first), then role, then digest of the text. Role and text null count as
one space, so a null role has no place in the pattern and a null text is blank. Initials are first
characters, case counts; a role without characters has none. Repeated rows count as many times as
they are there. A null conversation is one. A conversation whose rows were all dropped has zeros, an
empty audit and the digest of the empty text. Texts are read whole, an empty table gives an empty result, and only
the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.common import small_batches, stored

SEGMENT_ROWS = 256
# What a row is, beside its role's initial.
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
# States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (
    {"s": SYSTEM, "u": USER},
    {"u": USER},
    {"a": ASSISTANT},
    {"u": USER},
)
# The only initial that R and I can give in each state.
GIVEN = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
# By how much a segment's end in one state may cost more than its end after an assistant turn and still be of
# use: a turn can be inserted for INSERT, and the system turn that only START admits can be deleted for DELETE.
SLACK = max(INSERT, DELETE)
LEGAL = {"su", "ua", "au"}

Row = tuple[str, int]
Answer = tuple[int, str]


def bounds(rows: list[Row]) -> list[tuple[int, int]]:
    """Least cost of the rows from each place on, where a user (0) or an assistant turn (1) is due.

    Of a relaxed problem: system turns fit wherever a user turn is due, and the end is free.
    """
    after = [(0, 0)] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        stay = CUT_OFF if fault == TRUNCATED else 0
        least = []
        for due in (0, 1):
            cost = DELETE + after[i + 1][due]
            if fault < BLANK:
                if initial == "ua"[due]:
                    cost = min(cost, stay + after[i + 1][1 - due])
                elif initial == "s" and not due:
                    cost = min(cost, stay + after[i + 1][0])
                cost = min(cost, stay + REROLE + after[i + 1][1 - due])
            least.append(cost)
        after[i] = (min(least[0], INSERT + least[1]), min(least[1], INSERT + least[0]))
    return after


def moves(state: int, row: Row | None) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, rows used, state after) in ASCII order; no row: behind the last one."""
    if row is not None:
        yield "D", DELETE, 1, state
    yield "I", INSERT, 0, NEXT[state][GIVEN[state]]
    if row is not None and row[1] < BLANK:
        stay = CUT_OFF if row[1] == TRUNCATED else 0
        if row[0] in NEXT[state]:
            yield "K", stay, 1, NEXT[state][row[0]]
        yield "R", stay + REROLE, 1, NEXT[state][GIVEN[state]]


def search(rows: list[Row], entry: int = START) -> dict[int, Answer]:
    """The least (cost, audit) for each state in which the rows, begun in ``entry``, may usefully end."""
    ahead, n = bounds(rows), len(rows)

    def bound(i: int, state: int) -> int:
        return ahead[i][state == USER]

    # A dive along the bound gives the first incumbent; only its cost is used.
    i, state, cost = 0, entry, 0
    while i < n or state != ASSISTANT:
        row = rows[i] if i < n else None
        _, step, used, state = min(moves(state, row), key=lambda m: (m[1] + bound(i + m[2], m[3]), -m[2], m[0]))
        i, cost = i + used, cost + step
        if i == n:
            cost += INSERT * {START: 2, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]
            break
    allowed = cost + SLACK

    best: dict[tuple[int, int], Answer] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if cost + bound(i, state) > allowed:
            continue
        known = best.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        best[i, state] = (cost, audit)
        if i == n and state == ASSISTANT:
            allowed = min(allowed, cost + SLACK)
        row = rows[i] if i < n else None
        for letter, step, used, then in reversed(list(moves(state, row))):
            stack.append((i + used, then, cost + step, audit + letter))
    return {s: best[n, s] for s in range(4) if (n, s) in best}


def joined(now: dict[int, Answer], part: dict[int, dict[int, Answer]]) -> dict[int, Answer]:
    """The answers so far, one for each state, continued by a segment's."""
    out: dict[int, Answer] = {}
    for state, (cost, audit) in now.items():
        for end, (more, letters) in part.get(state, {}).items():
            found = (cost + more, audit + letters)
            if end not in out or found < out[end]:
                out[end] = found
    return out


class Digest:
    """SHA-256 of the repaired lines of one conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.sha, self.any = hashlib.sha256(), False

    def _line(self, role: str, text: str, initial: str) -> None:
        if self.any:
            self.sha.update(b"\n")
        self.any = True
        self.sha.update(f"{role}:{text}".encode())
        self.state = NEXT[self.state][initial]

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            given = GIVEN[self.state]
            self._line(NAMES[given], "", given)

    def row(self, role: str, text: str) -> None:
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._line(role, text, role[:1])
        elif letter == "R":
            given = GIVEN[self.state]
            self._line(NAMES[given], text, given)

    def end(self) -> str:
        self._inserted()
        return self.sha.hexdigest()


def damaged(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, turn, role, text) with the faults that a checksum of conversation and turn deals out."""
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`")
    key = F.concat(*[F.coalesce(c, F.lit(" ")) for c in (conv.cast("string"), F.lit(":"), turn.cast("string"))])
    kind = F.crc32(key.cast("binary")) % 20
    rows = df.select(
        conv.alias("conv"),
        turn.cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"),
        kind.alias("kind"),
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int")))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, times, fault): equal rows once; fault is what the first of them is."""
    white = r"[\x20\x09-\x0D]*"
    fault = (
        F.when(F.col("text").rlike(rf"\A{white}\z"), BLANK)
        .when(F.col("text").rlike(rf"[.!?]{white}\z"), FINE)
        .otherwise(TRUNCATED)
    )
    rows = rows.select("conv", "turn", "role", _digest().alias("digest"), fault.alias("fault"))
    once = rows.groupBy("conv", "turn", "role", "digest").agg(F.count("fault").alias("times"), F.first("fault").alias("fault"))
    once = stored(once, "turns")
    # The least turn at which a conversation has this role and text; a struct, as null is the least turn.
    first = once.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("least"))
    first = first.select(F.col("conv").alias("c"), F.col("least.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"))
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r"))
    once = once.join(first, same & (F.col("digest") == F.col("d")), "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("d").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return once.select("conv", "turn", "role", "digest", "times", fault.alias("fault"))


_SEGMENT = (
    "segment long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, "
    "answers array<struct<entry:int,state:int,cost:long,audit:string>>"
)


class _Segment:
    """A stretch of rows of one conversation, in order."""

    def __init__(self, conv):
        self.conv, self.rows, self.turns = conv, [], []

    def add(self, turn: int | None, role: str, fault: int) -> None:
        self.rows.append((role[:1], fault))
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def told(self) -> dict:
        count = [sum(f == kind for _, f in self.rows) for kind in (BLANK, DUPLICATE, TRUNCATED)]
        pairs = zip(self.rows, self.rows[1:], strict=False)
        answers = [
            {"entry": entry, "state": state, "cost": cost, "audit": audit}
            for entry in range(4)
            for state, (cost, audit) in search(self.rows, entry).items()
        ]
        return {
            "conv": self.conv,
            "blank": count[0], "duplicate": count[1], "truncated": count[2],
            "illegal": sum(a[0] + b[0] not in LEGAL for a, b in pairs),
            "first": self.rows[0][0], "last": self.rows[-1][0],
            "low": self.turns[0] if self.turns else None, "high": self.turns[-1] if self.turns else None,
            "turns": len(self.turns), "answers": answers,
        }


def segments(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The answers of every stretch of at most ``segment_rows`` rows of a conversation; ``segment`` gives their order."""
    kind = turns.schema["conv"].dataType
    out = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(_SEGMENT).fields])
    order = ["conv", "turn", "role", "digest"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        number = TaskContext.get().partitionId() << 32
        now, done = None, []

        def close() -> None:
            nonlocal number
            done.append(now.told() | {"segment": number})
            number += 1

        for batch in batches:
            for conv, turn, role, times, fault in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "times", "fault")], strict=True):
                for copy in range(times):
                    if now is not None and (now.conv != conv or len(now.rows) >= segment_rows):
                        close()
                        now = None
                    if now is None:
                        now = _Segment(conv)
                    now.add(turn, role, DUPLICATE if copy and fault != BLANK else fault)
            if len(done) >= 256:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return ranged.select("conv", "turn", "role", "times", "fault").mapInArrow(run, out)


class _Conversation:
    """One conversation, put together from its segments."""

    def __init__(self):
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last = self.low = self.high = None
        self.turns, self.answers, self.digest = 0, {START: (0, "")}, None

    def add(self, s: dict) -> None:
        for c in self.sums:
            self.sums[c] += s[c]
        if self.last is not None:
            self.sums["illegal"] += self.last + s["first"] not in LEGAL
        self.last = s["last"]
        if s["low"] is not None:
            self.turns += s["turns"] - (self.high == s["low"])
            self.low = s["low"] if self.low is None else self.low
            self.high = s["high"]
        part: dict[int, dict[int, Answer]] = {}
        for a in s["answers"]:
            part.setdefault(a["entry"], {})[a["state"]] = (a["cost"], a["audit"])
        self.answers = joined(self.answers, part)

    def best(self) -> Answer:
        return min(self.answers[s] for s in (START, ASSISTANT) if s in self.answers)

    def row(self, role: str, text: str) -> None:
        if self.digest is None:
            self.digest = Digest(self.best()[1])
        self.digest.row(role, text)

    def told(self) -> dict:
        cost, audit = self.best()
        digest = self.digest or Digest(audit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.sums | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest.end()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv, gaps, ..., repaired_sha256) of each conversation of ``conversations`` (conv), from rows (conv, turn, role, text)."""
    kind = rows.schema["conv"].dataType
    parts = stored(segments(faults(rows), segment_rows), "segments")
    answer = [c for c in parts.columns if c != "conv"]
    # One stream: first a conversation's name, then its segments, then its rows, each in order.
    names = conversations.select("conv", F.lit(0).alias("what"))
    answers = parts.select("conv", F.lit(1).alias("what"), F.col("segment").alias("at"), F.struct(*answer).alias("part"))
    texts = rows.select("conv", F.lit(2).alias("what"), F.col("turn").alias("at"), "role", "text", _digest().alias("digest"))
    stream = names.unionByName(answers, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "what", "at", "role", "digest")
    small_batches(rows.sparkSession)
    out = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        name, now, done = None, None, []
        for batch in batches:
            for conv, what, role, text, part in zip(*[batch.column(c).to_pylist() for c in ("conv", "what", "role", "text", "part")], strict=True):
                if what == 0:
                    if now is not None:
                        done.append(now.told() | {"conv": name})
                    name, now = conv, _Conversation()
                elif what == 1:
                    now.add(part)
                else:
                    now.row(role, text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.told() | {"conv": name}], schema)

    return stream.select("conv", "what", "role", "text", "part").mapInArrow(run, out)


def check(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """(conv, gaps, ..., repaired_sha256): every conversation of ``df``, damaged and repaired."""
    rows = damaged(df, conv_col, turn_col, role_col, text_col)
    return repair(rows, df.select(F.col(f"`{conv_col}`").alias("conv")).distinct(), segment_rows)
