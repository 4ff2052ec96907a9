"""Mixing, multi-query ranking and conversation repair against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import dialogue_repair, lexical, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words(n, rng):
    return " ".join(rng.choice(["the", "of", "cat", "dog", "blue", "sky", "Ünit", "naïve", "x1"]) + str(rng.randrange(40)) for _ in range(n))


# --- mixing -----------------------------------------------------------------


def plain_mix(rows, weights=(5, 2, 1), most=3):
    """By sorting all documents of a source by their hash."""
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    above = set()
    while True:
        left = sum(size.values()) - most * sum(size[s] for s in above)
        share = sum(weight[s] for s in order if s not in above)
        more = {s for s in order if s not in above and most * size[s] * share < left * weight[s]}
        if not more:
            break
        above |= more
    target = {s: float(most * size[s]) if s in above else left * weight[s] / share for s in order}
    out = []
    for s in order:
        group = collections.defaultdict(list)
        for doc_id, text, source in rows:
            if source == s:
                key = f"{'' if doc_id is None else doc_id}:{text or ''}".encode()
                n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
                group[hashlib.md5(key).hexdigest()[:15]].append((doc_id, n))
        times = min(most, math.floor(target[s] / size[s])) if size[s] else 0
        rest = target[s] - times * size[s] if times < most else 0
        before = 0
        for h in sorted(group):
            together = sum(n for _, n in group[h])
            extra = 2 * (rest - before) > together
            out += [(d, n, size[s], target[s], n * (times + extra)) for d, n in group[h]]
            before += together
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("kind", ["many", "hot", "few words"])
def test_mix_against_sorting(spark, kind, monkeypatch):
    rng = random.Random(3)
    sources = {"many": [f"s{i}" for i in range(40)] + [None, "", "é", "🙂"], "hot": ["a", "b"], "few words": ["a", "b", "c", "d"]}[kind]
    rows = []
    for i in range(400):
        source = "a" if kind == "hot" and i % 3 else rng.choice(sources)
        n = 0 if kind == "few words" and source != "a" and i % 5 else rng.choice([0, 1, 3, 10, 50])
        rows.append((i, words(n, rng) if n else rng.choice(["", None, " \n"]), source))
    rows += [(7, "same row again", "a")] * 5 + [(None, "no id", "a"), (None, "no id", "a"), (8, "w " * 20_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "LEVEL_BITS", 4)
    told = mixing.shares(df).select("id", "size", "source_size", "target", "taken")
    got = [tuple(r) for r in told.collect()]
    assert order(got) == order(plain_mix(rows))
    assert order(map(tuple, mixing.shares(df.repartition(7)).select(*told.columns).collect())) == order(got)
    near = {}
    for _, n, size, target, taken in got:
        assert taken <= 3 * n
        near.setdefault((size, target), []).append((n, taken))
    if kind == "hot":
        for (_, target), some in near.items():
            assert abs(sum(t for _, t in some) - target) <= max(max(n for n, _ in some), 5 * 3) / 2


def test_mixed_table_holds_rows_as_often_as_told(spark, empty):
    rng = random.Random(5)
    rows = [(i, words(rng.randrange(30), rng), "en", rng.choice(["a", "b", "c", None]), i) for i in range(120)] + [(500, None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS id", "2 AS size", "3 AS hash", "4 AS times", "5 AS target", "6 AS `row`")
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = collections.Counter(r["doc_id"] for r in mixed.collect())
    told = {r["id"]: r["times"] for r in mixing.shares(df).collect()}
    assert counts == collections.Counter({k: v for k, v in told.items() if v})
    assert mixing.shares(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.source_size, r.target, r.taken) for r in mixing.shares(blank).collect()] == [(0, 0, 0.0, 0)] * 2


# --- ranking ----------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain_rank(docs, items, k=50):
    bags = [(d, collections.Counter(plain_terms(t))) for d, t in docs]
    total, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scored = []
        for d, b in bags:
            n, score = sum(b.values()), 0
            m = 50 + (50 * n * total) // max(length, 1)
            for t in set(plain_terms(text)) & set(b):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is not None, d))
        scored.sort()
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return out


def test_rank_against_scoring_each_pair(spark, monkeypatch):
    rng = random.Random(11)
    docs = [(i, words(rng.choice([0, 1, 5, 40]), rng)) for i in range(150)]
    docs += [(i + 1000, docs[i][1]) for i in range(60)] + [docs[20]] * 3
    docs += [(None, "the1 cat2"), (5000, None), (5001, "..., --"), (5002, "THE1 Ünit3\x00naïve4 x1" * 300), (5003, "dog7 " * 40_000)]
    shared = words(12, rng)
    items = [(i, shared + " " + words(rng.randrange(15), rng)) for i in range(25)]
    items += [(100, None), (101, "!!"), (102, "Dog7"), (102, "sky3 sky3"), (102, "Dog7"), (103, shared), (104, "nowhere unknown")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS terms", "3 AS n").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS low", "3 AS number")
    want = sorted(plain_rank(docs, items), key=str)
    for at_once, block in ((1000, 128), (9, 4)):
        got = [tuple(r) for r in lexical.rank(d, q, items_at_once=at_once, block_items=block).collect()]
        assert sorted(got, key=str) == want, (at_once, block)
    assert lexical.rank(d.limit(0), q).count() == 0
    assert lexical.rank(d, q.limit(0)).count() == 0


def test_long_lists_keep_the_best_and_ties_go_to_the_smaller_id(spark):
    docs = [(i, "apple pear" if i % 2 else "apple") for i in range(900, 0, -1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame([(1, "apple"), (2, "pear apple")], "item_id long, text string")
    assert sorted(map(tuple, lexical.rank(d, q, k=50).collect())) == sorted(plain_rank(docs, [(1, "apple"), (2, "pear apple")]))


def test_sums_are_shared_and_hold_each_term_once():
    rng = random.Random(2)
    vocabulary = [b"t%d" % i for i in range(60)]
    for trial in range(60):
        groups = [rng.sample(vocabulary, 6) for _ in range(4)]
        items = [sorted({t for g in rng.sample(groups, rng.randrange(1, 4)) for t in g} | set(rng.sample(vocabulary, rng.randrange(4)))) for _ in range(rng.randrange(1, 12))]
        atoms, sums, roots = lexical.mine(items, mined=rng.choice([0, 3, 1000]))
        below = [list(a) for a in atoms]
        for a, b in sums:
            below.append(below[a] + below[b])
        for terms, nodes in zip(items, roots, strict=True):
            assert sorted(itertools.chain(*[below[n] for n in nodes])) == terms
        additions = sum(len(a) - 1 for a in atoms) + len(sums) + sum(len(r) - 1 for r in roots if r)
        assert additions <= sum(len(t) - 1 for t in items)
    # Three items that share five terms two by two: the pairs' sums are formed once.
    items = [[b"a", b"b", b"c", b"x"], [b"a", b"b", b"c", b"y"], [b"b", b"c", b"x", b"y"]]
    atoms, sums, roots = lexical.mine(items)
    assert [b"b", b"c"] in atoms and sums and max(map(len, roots)) < 4
    acc = lexical.accumulators(len(atoms) + len(sums), sums, np.array([0]), 2, np.array([0, 1]), np.array([0, 0]), np.array([3, 4]))
    assert acc[0].tolist() == [3, 4]


# --- conversations ----------------------------------------------------------


def plain_best(rows):
    """The least (cost, audit) by trying the ways of every row, with at most three insertions in a row."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    reached = {0: (0, "")}

    def widen(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                then = step[state]["a" if state == 2 else "u"]
                if then not in now or (cost + 3, audit + "I") < now[then]:
                    now[then] = (cost + 3, audit + "I")
        return now

    for initial, fault in rows:
        out = {}
        for state, (cost, audit) in widen(reached).items():
            ways = [(state, 4, "D")]
            if fault < 2:
                extra = 3 * (fault == 1)
                if initial in step[state]:
                    ways.append((step[state][initial], extra, "K"))
                ways.append((step[state]["a" if state == 2 else "u"], 3 + extra, "R"))
            for then, more, letter in ways:
                found = (cost + more, audit + letter)
                if then not in out or found < out[then]:
                    out[then] = found
        reached = out
    return min(v for k, v in widen(reached).items() if k in (0, 3))


def test_search_finds_the_least_cost_and_audit():
    rng = random.Random(8)
    for trial in range(4000):
        rows = [(rng.choice("uuaasx") if trial % 2 else "ua"[i % 2], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randrange(1, 13))]
        found = dialogue_repair.search(rows)
        assert min(found[s] for s in (0, 3) if s in found) == plain_best(rows), rows
        # Cut anywhere, the parts' answers give the same.
        now = {0: (0, "")}
        at = 0
        while at < len(rows):
            size = rng.randrange(1, 5)
            part = {e: dialogue_repair.search(rows[at : at + size], e) for e in range(4)}
            now, at = dialogue_repair.joined(now, part), at + size
        assert min(now[s] for s in (0, 3) if s in now) == plain_best(rows), rows


def test_bounds_are_below_every_continuation():
    rng = random.Random(9)
    for _ in range(500):
        rows = [(rng.choice("uas"), rng.choice([0, 1, 2])) for _ in range(rng.randrange(1, 9))]
        assert dialogue_repair.bounds(rows)[0][0] <= plain_best(rows)[0]


def plain_repair(rows):
    """The whole contract, one conversation at a time."""
    given, out = collections.defaultdict(list), []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        given[conv]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        given[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, some in given.items():
        some.sort(key=lambda r: (r[0] is not None, r[0], r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in some:
            bare = text.strip(" \t\n\v\f\r")
            faults.append(2 if not bare else 3 if (role, text) in seen else int(bare[-1] not in ".!?"))
            seen.add((role, text))
        cost, audit = plain_best([(r[1][:1], f) for r, f in zip(some, faults, strict=True)]) if some else (0, "")
        lines, state, at = [], 0, iter(some)
        for letter in audit:
            turn, role, text = (None, "", "") if letter == "I" else next(at)
            if letter in "IR":
                role = "assistant" if state == 2 else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
        turns = {r[0] for r in some} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count(2), faults.count(3), faults.count(1), illegal, cost, audit, digest))
    return out


NAMES = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(60), None]:
        turn = 0
        for _ in range(rng.randrange(1, 10)):
            turn += rng.choice([1, 1, 1, 2, 0])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            text = rng.choice(["Hello there.", "What?", "no end", "", " \n", None, "漢字。", "Bye!\n\n", "a\nb.", "again."])
            rows.append((conv, rng.choice([turn, turn, turn, None]) if conv == 3 else turn, role, text))
    rows += [(999, i, "user" if i % 2 else "assistant", "Same again." if i % 3 else f"Line {i}.") for i in range(700)]
    rows += [(998, 1, "user", "equal rows.")] * 30 + [(997, None, "user", "x."), (997, None, "assistant", "y.")]
    rows += [(996, i, "user", "z. " * 50_000) for i in range(3)]
    rows = list(dict.fromkeys(rows[:-36])) + rows[-36:]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS conv", "2 AS fault", "3 AS digest", "4 AS what")
    want = sorted(plain_repair(rows), key=str)
    for size in (256, 7):
        told = dialogue_repair.check(df.repartition(5), segment_rows=size)
        assert told.columns == NAMES
        assert sorted(map(tuple, told.collect()), key=str) == want
    dropped = next(i for i in itertools.count(5000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "Hi.")], schema)
    assert tuple(dialogue_repair.check(gone).first()) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dialogue_repair.check(gone.limit(0)).count() == 0


def test_search_on_a_long_stretch_stays_small():
    rng = random.Random(1)
    rows = [(rng.choice("uas"), rng.choice([0, 0, 1, 2])) for _ in range(2000)]
    found = dialogue_repair.search(rows)
    assert min(found[s] for s in (0, 3) if s in found) == plain_best(rows)


def test_repair_of_the_supplied_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = dialogue_repair.check(df)
    assert got.select(F.sum("cost")).first()[0] > 0
    assert sorted(map(tuple, got.collect())) == sorted(plain_repair(rows))
