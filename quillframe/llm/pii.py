"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns give the base spans. Around digits and at-signs, a semi-Markov model
scores whole candidate segments (number of digits, grouping, separators, check
digits, neighbours) for each kind, and a dynamic program over segments of at most
``MAX_TOKENS`` tokens chooses boundaries and kinds together. Its segments are
added where they overlap no base span and beat "outside" by ``MARGIN``.

The model is fitted on the driver by maximum likelihood on at most
``TRAIN_REGIONS`` regions of a bounded sample of documents, labelled by the
patterns; changed copies of them teach it spans that run over a line end or
adjoin another number, and wrong parts.

Nulls count as empty text; texts are read whole, in time linear in their length;
repeated rows are treated alike; an empty table gives an empty result (with
nothing to fit on, only base spans are found). Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import map_rows, text

KINDS = ("email", "ip", "card", "phone")
# Bounded fit: documents sampled, pieces taken from each and their characters, regions kept, passes over them.
TRAIN_DOCUMENTS, TRAIN_PIECES, TRAIN_CHARS, TRAIN_REGIONS, PASSES = 4000, 10, 400, 1200, 8
MAX_TOKENS, MARGIN, FEATURES = 16, 2.0, 4096

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# A stretch of digits with single separators holds every ip and card.
_DIGITS = re.compile(r"[0-9](?:[ .-]?[0-9])+")
# Where the model looks: digits with short gaps (also over a line end), with an opening mark before them.
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[\s().,/-]{0,3}[0-9])*")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(t: str) -> list[tuple[int, int]]:
    """Each at-sign has one possible match: the run of allowed characters before it, a domain after it."""
    out, end = [], 0
    at = t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(t, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = t.find("@", max(at + 1, end))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(t)] if "@" in t else []
    ips, cards = [], []
    for run in _DIGITS.finditer(t):
        if run.end() - run.start() < 7:
            continue
        a, b = run.span()
        for m in _IP.finditer(t, a, b):
            if all(map(small_part, m[0].split("."))):
                ips.append((1, *m.span()))
        for m in _CARD.finditer(t, a, b):
            digits = digits_of(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                cards.append((2, *m.span()))
    phones = []
    if "+" in t:
        phones = [(3, *m.span()) for m in _PHONE.finditer(t) if 9 <= len(digits_of(m[0])) <= 15]
    return out + ips + cards + phones


def regions(t: str) -> list[tuple[int, int]]:
    """Disjoint stretches that may hold a span: around digits, and words with an at-sign."""
    found = []
    at = t.find("@")
    while at >= 0:
        a = b = at
        while a > 0 and not t[a - 1].isspace() and at - a < 64:
            a -= 1
        while b < len(t) and not t[b].isspace() and b - at < 128:
            b += 1
        found.append((a, b))
        at = t.find("@", b)
    found += [m.span() for m in _NUMBERS.finditer(t) if sum(c.isdigit() for c in m[0]) >= 4]
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tokens(t: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(t, a, b)]


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def segment_features(t: str, a: int, b: int) -> list[int]:
    """Features of a whole candidate span; the kind is paired with them by its own weights."""
    s = t[a:b]
    digits = digits_of(s)
    gaps = re.sub(r"[^\W_]+", "", s)
    groups = re.findall(r"[0-9]+", s)
    before, after = t[a - 1 : a], t[b : b + 1]
    n = len(digits)
    names = [
        "bias",
        f"digits={min(n, 24)}",
        f"card length={13 <= n <= 19 and luhn(digits)}",
        f"phone length={9 <= n <= 15 and s[0] == '+'}",
        f"plus={s[0] == '+'}",
        f"at={s.count('@')},{bool(_DOMAIN.fullmatch(s.rpartition('@')[2])) if '@' in s else 0}",
        f"letters={any(c.isalpha() for c in s)}",
        f"gaps={''.join(sorted(set(gaps.replace(chr(10), ' '))))}",
        f"groups={min(len(groups), 9)}",
        f"parts={len(groups) == 4 and gaps == '...' and all(map(small_part, groups))}",
        f"wide gap={bool(re.search(r'[^0-9A-Za-z+]{3}', s))}",
        f"before={'a' if before.isalnum() else before if before in '+-.@_' else 's'}",
        f"after={'a' if after.isalnum() else after if after in '+-@_%' else 's'}",
        f"digit near={t[a - 2 : a][:1].isdigit() and before in ' .-'},{t[b + 1 : b + 2].isdigit() and after in ' .-'}",
    ]
    return [_feature(x) for x in names]


def token_features(t: str, a: int, b: int) -> list[int]:
    """Features of a token outside any span."""
    s = t[a:b]
    kind = "digits" if s[0].isdigit() else "letters" if s[0].isalpha() else "gap" if s.isspace() else s
    return [_feature("outside"), _feature(f"outside {kind}"), _feature(f"outside {kind} {min(len(s), 20)}")]


class Lattice:
    """All candidate segments of a region with their features."""

    def __init__(self, t: str, a: int, b: int):
        self.spans = tokens(t, a, b)
        n = len(self.spans)
        self.outside = [token_features(t, x, y) for x, y in self.spans]
        ends = [t[x].isalnum() for x, _ in self.spans]
        opens = [ends[i] or t[x] in "+(" for i, (x, _) in enumerate(self.spans)]
        self.by_end: list[list[tuple[int, list[int]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if not opens[i]:
                continue
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                x, y = self.spans[i][0], self.spans[j - 1][1]
                if ends[j - 1] and y - x >= 7:
                    self.by_end[j].append((i, segment_features(t, x, y)))

    def scored(self, weights: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, np.ndarray]]]]:
        """Scores of single tokens outside, and of each segment by kind."""
        out = np.array([weights[-1, f].sum() for f in self.outside])
        return out, [[(i, weights[:-1, f].sum(axis=1)) for i, f in at] for at in self.by_end]

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(kind, start, end, lead over outside) of the best segmentation."""
        single, segments = self.scored(weights)
        n = len(self.spans)
        total, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        sums = np.concatenate([[0.0], np.cumsum(single)])
        for j in range(1, n + 1):
            total[j], back[j] = total[j - 1] + single[j - 1], (j - 1, -1)
            for i, scores in segments[j]:
                k = int(scores.argmax())
                if total[i] + scores[k] > total[j]:
                    total[j], back[j] = total[i] + float(scores[k]), (i, k)
        out, j = [], n
        while j:
            i, k = back[j]
            if k >= 0:
                lead = total[j] - total[i] - (sums[j] - sums[i])
                out.append((k, self.spans[i][0], self.spans[j - 1][1], lead))
            j = i
        return out[::-1]

    def gradient(self, weights: np.ndarray, gold: set[tuple[int, int, int]], step: float) -> None:
        """One step up the log-likelihood of ``gold`` segments, by forward and backward sums."""
        single, segments = self.scored(weights)
        n = len(self.spans)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0.0
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp(ahead[j], ahead[j - 1] + single[j - 1])
            for i, scores in segments[j]:
                ahead[j] = np.logaddexp(ahead[j], ahead[i] + np.logaddexp.reduce(scores))
        for j in range(n, 0, -1):
            behind[j - 1] = np.logaddexp(behind[j - 1], behind[j] + single[j - 1])
            for i, scores in segments[j]:
                behind[i] = np.logaddexp(behind[i], behind[j] + np.logaddexp.reduce(scores))
        covered = np.zeros(n, bool)
        for j in range(1, n + 1):
            for (i, features), (_, scores) in zip(self.by_end[j], segments[j], strict=True):
                change = -np.exp(ahead[i] + scores + behind[j] - ahead[n])
                for k in range(len(KINDS)):
                    if (k, self.spans[i][0], self.spans[j - 1][1]) in gold:
                        change[k] += 1
                        covered[i:j] = True
                np.add.at(weights, (slice(0, -1), features), step * change[:, None])
        for j in range(n):
            p = np.exp(ahead[j] + single[j] + behind[j + 1] - ahead[n])
            np.add.at(weights[-1], self.outside[j], step * ((0.0 if covered[j] else 1.0) - p))


def fit(texts: list[str], seed: int = 7) -> np.ndarray | None:
    """Weights (kinds and outside x features) from the pattern-labelled regions of ``texts``."""
    rng = np.random.default_rng(seed)
    examples: list[tuple[str, int, int, set]] = []
    phone = card = ""
    for t in texts:
        spans = base_spans(t)
        for a, b in regions(t):
            if len(examples) >= TRAIN_REGIONS:
                break
            if b - a > TRAIN_CHARS:  # a bound of the fit alone: segments are far shorter
                continue
            shift = max(0, a - 2)
            around, a, b = t[shift : b + 2], a - shift, b - shift
            gold = {(k, x - shift, y - shift) for k, x, y in spans if a <= x - shift and y - shift <= b}
            examples.append((around, a, b, gold))
            if len(gold) != 1:
                continue
            # Changed copies: over a line end, with a part too large, and two numbers in a row.
            ((k, x, y),) = gold
            gaps = [i for i in range(x, y) if around[i] in " -"] if k > 1 else []
            if gaps:
                at = int(rng.choice(gaps))
                examples.append((around[:at] + "\n" + around[at + 1 :], a, b, gold))
            if k == 2 and around[x:y].isdigit():
                card = around[x:y]
                at = int(rng.integers(x + 1, y))
                examples.append((around[:at] + "\n" + around[at:], a, b + 1, {(k, x, y + 1)}))
            if k == 1:
                examples.append((around[:y] + "99" + around[y:], a, b + 2, set()))
            phone = around[x:y] if k == 3 else phone
            if k > 1 and phone and card:
                n, m = len(phone), len(card)
                examples.append((f" {phone} {card} ", 1, n + m + 2, {(3, 1, 1 + n), (2, n + 2, n + m + 2)}))
                examples.append((f" {card} {phone} ", 1, n + m + 2, {(2, 1, 1 + m), (3, m + 2, n + m + 2)}))
    if not examples:
        return None
    made = [(Lattice(t, a, b), gold) for t, a, b, gold in examples]
    weights = np.zeros((len(KINDS) + 1, FEATURES))
    for n in range(PASSES):
        for i in rng.permutation(len(made)):
            lattice, gold = made[i]
            lattice.gradient(weights, gold, 0.2 / (1 + n))
    return weights


def all_spans(t: str, weights: np.ndarray | None) -> list[tuple[int, int, int, bool]]:
    """Base spans and those the model adds, by kind, then start."""
    base = base_spans(t)
    out = [(*s, True) for s in base]
    if weights is not None:
        by_start = sorted((x, y) for _, x, y in base)
        # The base spans as disjoint stretches, in order.
        starts, ends = [], []
        for x, y in by_start:
            if ends and x < ends[-1]:
                ends[-1] = max(ends[-1], y)
            else:
                starts.append(x)
                ends.append(y)
        at, open_spans = 0, []
        for a, b in regions(t):  # in order, so every span is looked at once
            open_spans = [s for s in open_spans if s[1] > a]
            while at < len(by_start) and by_start[at][0] < b:
                if by_start[at][1] > a:
                    open_spans.append(by_start[at])
                at += 1
            if any(x <= a and b <= y for x, y in open_spans):
                continue
            for k, x, y, lead in Lattice(t, a, b).best(weights):
                last = bisect_left(starts, y) - 1
                if lead >= MARGIN and (last < 0 or ends[last] <= x):
                    out.append((k, x, y, False))
    out.sort(key=lambda s: (s[0], s[1], s[2]))
    return out


def sample_texts(df: DataFrame, id_col: str, text_col: str) -> list[str]:
    """At most TRAIN_DOCUMENTS texts with a digit or at-sign, the same ones for the same table.

    Lines are cut into pieces of ``TRAIN_CHARS``; of the pieces with one, anywhere in the text,
    the ``TRAIN_PIECES`` with the smallest hashes are brought to the driver.
    """
    # The choice is by hash of the id: a top-k, so every task sends at most k rows.
    cut = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[^\\n]{{1,{TRAIN_CHARS}}}"), F.lit(0))
    hashed = F.transform(F.filter(cut, lambda x: x.rlike("[0-9@]")), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))
    body = F.array_join(F.slice(F.sort_array(hashed), 1, TRAIN_PIECES)["x"], "\n")
    rows = (
        df.filter(F.col(f"`{text_col}`").rlike(r"[0-9]{4}|@"))
        .select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), body.alias("t"))
        .orderBy("h", "t")
        .limit(TRAIN_DOCUMENTS)
    )
    return [r["t"] for r in rows.collect()]


def find(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: np.ndarray | None = None,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, *keep, spans array<struct<kind, start, end, base>>) by kind, then start; code points, end exclusive.

    ``weights`` come from ``fit``; by default they are fitted on a sample of ``df``.
    """
    if weights is None:
        weights = fit(sample_texts(df, id_col, text_col))
    keep = keep or {}
    kind = df.schema[id_col].dataType.simpleString()
    kept = df.select(*[c.alias(n) for n, c in keep.items()]).schema.fields if keep else []

    names = ["id", *keep]

    def make():
        def work(given: dict[str, list]) -> dict[str, list]:
            rows = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": c} for k, a, b, c in all_spans(t, weights)]
                for t in given["text"]
            ]
            return {n: given[n] for n in names} | {"spans": rows}

        return work

    schema = ", ".join([f"id {kind}", *[f"`{f.name}` {f.dataType.simpleString()}" for f in kept]])
    schema += ", spans array<struct<kind: string, start: long, end: long, base: boolean>>"
    return map_rows(df, {"id": F.col(f"`{id_col}`"), **keep, "text": text(text_col)}, make, schema)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced by ``<KIND>``; null texts stay null.

    Overlapping spans are replaced as one, under the kind of the first.
    """
    weights = fit(sample_texts(df, id_col, text_col))

    def make():
        def work(given: dict[str, list]) -> dict[str, list]:
            out = []
            for t in given["text"]:
                if t is None:
                    out.append(None)
                    continue
                done, at = [], 0
                for k, a, b, _ in sorted(all_spans(t, weights), key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        done += [t[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, b)
                out.append("".join([*done, t[at:]]))
            return given | {"text": out}

        return work

    columns = {f"c{i}" if c != text_col else "text": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
    types = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(columns, df.columns, strict=True)]
    return map_rows(df, columns, make, ", ".join(types)).toDF(*df.columns)
