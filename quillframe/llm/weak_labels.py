"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are the words of a lexicon, text patterns, words and word beginnings that
the labelled sample shows to go with the label, and the label itself. None is
trusted: expectation maximisation estimates how often each fires on either class,
the correlation of what is left of every two voters then lowers the say of
voters that repeat each other, and the two steps alternate. The posterior of each
sampled row is what a logistic regression on hashed words and word beginnings is
fitted to. Every whole text is then scored by that regression in its own row.

The fit uses at most ``CLASS_ROWS`` labelled rows of either class, the same ones for
the same table, gathered on the driver as feature numbers. Their weights give the
toxic ones the share ``PRIOR``, so that verdicts do not follow the class shares of the
table or of the sample. Scores see only the text.

Null and empty texts have no features and get the score of the intercept; null
labels are not learnt from; repeated rows score alike; without any labelled row
all scores are 0; an empty table gives an empty result. Only the named columns are
read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import map_rows, text

CLASS_ROWS = 5000
# The share that toxic rows are taken to have, at every size of table and sample.
PRIOR = 0.5
BUCKETS = 1 << 20
BEGINNING = 5
LEARNT_VOTERS, LEAST_ROWS, LEAST_ODDS = 60, 5, 12
CACHE_WORDS = 300_000
# Own choice of insulting words.
LEXICON = (
    "idiot moron stupid loser pathetic scum worthless trash clown disgusting dumb fool jerk filth vermin "
    "imbecile creep coward liar garbage shut hate kill ugly freak bastard bitch damn crap hell"
).split()
PATTERNS = {
    "addressed insult": re.compile(r"\b(?:you|this|he|she|they)\s+(?:are\s+|is\s+)?(?:an?\s+|such\s+)?(?:" + "|".join(LEXICON) + r")\b", re.I),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[^a-z]{0,3}){4}"),
    "many marks": re.compile(r"[!?]{3,}"),
}
_WORD = re.compile(r"\w+")


class Features(dict):
    """The two feature numbers of a word: itself and its beginning; kept up to a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = (zlib.crc32(word.encode()) % BUCKETS,)
        if len(word) > BEGINNING:
            found += (zlib.crc32(word[:BEGINNING].encode() + b"*") % BUCKETS,)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, t: str) -> set[int]:
        out: set[int] = set()
        out.update(*map(self.__getitem__, set(_WORD.findall(t.lower()))))
        return out


@dataclass
class LabelModel:
    posterior: np.ndarray
    on_toxic: np.ndarray
    on_clean: np.ndarray
    correlation: np.ndarray
    say: np.ndarray


def fit_label_model(votes: np.ndarray, start: np.ndarray, two_sided: np.ndarray, trusted: np.ndarray, rounds: int = 20, weight: np.ndarray | None = None) -> LabelModel:
    """Accuracies and correlations of voters (rows x voters, fired or not) by expectation maximisation.

    A voter that does not fire abstains, but for the ``two_sided`` ones. Shares of
    ``trusted`` voters start from, and are held near, firing on 95 and 5 of a
    hundred rows of either class; those of all others come from the rows alone. Rows count by ``weight``.
    """
    n, m = votes.shape
    fired = votes.astype(np.float64)
    weight = np.ones(n) if weight is None else weight * (n / weight.sum())
    p = np.clip(start.astype(np.float64), 0.02, 0.98)
    say, correlation = np.ones(m), np.eye(m)
    held = np.where(trusted, float(n), 1.0)
    for _ in range(rounds):
        toxic, clean = weight * p, weight * (1 - p)
        on_toxic = (fired.T @ toxic + held * np.where(trusted, 0.95, 0.1)) / (toxic.sum() + held)
        on_clean = (fired.T @ clean + held * np.where(trusted, 0.05, 0.1)) / (clean.sum() + held)
        base = np.clip(toxic.mean(), 0.001, 0.999)
        # What the classes leave unexplained, by pairs of voters.
        rest = fired - (p[:, None] * on_toxic + (1 - p)[:, None] * on_clean)
        rest *= np.sqrt(weight)[:, None]
        spread = np.sqrt((rest * rest).sum(axis=0)) + 1e-9
        correlation = (rest.T @ rest) / np.outer(spread, spread)
        say = 1 / (1 + np.clip(np.abs(correlation) - np.eye(m) - 0.1, 0, None).sum(axis=1))
        say = np.where(trusted, 1.0, say)
        yes, no = np.log(on_toxic / on_clean), np.log((1 - on_toxic) / (1 - on_clean))
        logit = np.log(base / (1 - base)) + fired @ (say * yes) + ((1 - fired) * two_sided) @ (say * no)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return LabelModel(p, on_toxic, on_clean, correlation, say)


def fit_linear(
    rows: list[np.ndarray], target: np.ndarray, of_row: np.ndarray, steps: int = 300, rate: float = 1.0, shrink: float = 3e-4
) -> tuple[np.ndarray, float]:
    """Logistic regression on present features with soft targets: gradient steps with momentum, L2.

    Rows count by the weights ``of_row``.
    Features are centred on their shares, so the intercept takes up what all rows
    have in common; features of fewer than LEAST_ROWS rows are left out.
    """
    counts = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    rows = [r[counts[r] >= LEAST_ROWS] for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, flat = np.unique(np.concatenate(rows), return_inverse=True)
    weight = of_row
    share = np.bincount(flat, weight[owner], minlength=len(used)) / weight.sum()
    w, move_w = np.zeros(len(used)), np.zeros(len(used))
    base = np.clip((weight * target).sum() / weight.sum(), 0.001, 0.999)
    b, move_b = float(np.log(base / (1 - base))), 0.0
    for _ in range(steps):
        z = np.bincount(owner, w[flat], minlength=len(rows)) + (b - share @ w)
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / weight.sum()
        slope = np.bincount(flat, gap[owner], minlength=len(used)) - share * gap.sum() + shrink * w
        move_w = 0.9 * move_w - rate * slope
        move_b = 0.9 * move_b - rate * gap.sum()
        w += move_w
        b += move_b
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w
    return out, float(b - share @ w)


def held_out(id_column: Column) -> Column:
    """The fifth of all ids that nothing is learnt from."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0


def _sampled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """(feature numbers, patterns fired, labels) of the sampled rows."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    # An id labelled more than once counts once, as toxic if any of its labels says so.
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(CLASS_ROWS)
        chosen = some if chosen is None else chosen.union(some)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def make():
        features = Features()

        def work(given: dict[str, list]) -> dict[str, list]:
            return {
                "id": given["id"],
                "y": given["y"],
                "features": [sorted(features.of(t)) for t in given["text"]],
                "fired": [[bool(p.search(t)) for p in PATTERNS.values()] for t in given["text"]],
            }

        return work

    kind = df.schema[id_col].dataType.simpleString()
    found = map_rows(
        rows, {c: F.col(c) for c in ("id", "y", "text")}, make, f"id {kind}, y int, features array<int>, fired array<boolean>"
    )
    # One row an id, so that the bound holds for ids with many rows.
    found = found.groupBy("id").agg(F.min(F.struct("y", "features", "fired")).alias("row")).select("row.*").toPandas()
    # The same rows in any order of arrival.
    found["order"] = [zlib.crc32(np.asarray(f, np.int32).tobytes()) for f in found["features"]]
    found = found.sort_values(["order", "y"], kind="stable")
    features = [np.asarray(f, np.int64) for f in found["features"]]
    fired = np.array(found["fired"].tolist(), bool).reshape(len(found), len(PATTERNS))
    return features, fired, found["y"].to_numpy()


def class_weights(y: np.ndarray) -> np.ndarray:
    """Weights that give the rows labelled toxic the share PRIOR of all, whatever their number."""
    toxic = int((y == 1).sum())
    if toxic in (0, len(y)):
        return np.ones(len(y))
    return np.where(y == 1, PRIOR / toxic, (1 - PRIOR) / (len(y) - toxic)) * len(y)


def learnt_voters(features: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features that are many times as frequent on label 1 as on label 0."""
    toxic = np.bincount(np.concatenate([f for f, t in zip(features, y, strict=True) if t == 1] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    clean = np.bincount(np.concatenate([f for f, t in zip(features, y, strict=True) if t == 0] or [np.zeros(0, np.int64)]), minlength=BUCKETS)
    odds = np.log((toxic + 0.5) / (max((y == 1).sum(), 1) + 1)) - np.log((clean + 0.5) / (max((y == 0).sum(), 1) + 1))
    odds[toxic < LEAST_ROWS] = -np.inf
    best = np.argsort(-odds, kind="stable")[:LEARNT_VOTERS]
    return best[odds[best] > np.log(LEAST_ODDS)]


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, float] | None:
    """Weights and intercept of the classifier; None without labelled rows."""
    features, fired, y = _sampled(df, labels, id_col, text_col, label_col)
    if not features:
        return None
    weight = class_weights(y)
    find = Features()
    voters = list(dict.fromkeys([find[w][0] for w in LEXICON] + learnt_voters(features, y).tolist()))
    place = {f: i for i, f in enumerate(voters)}
    votes = np.zeros((len(y), len(voters)), bool)
    for i, f in enumerate(features):
        votes[i, [place[x] for x in f.tolist() if x in place]] = True
    votes = np.concatenate([votes, fired, (y == 1)[:, None], votes.any(axis=1)[:, None]], axis=1)
    sides = np.zeros(votes.shape[1], bool)
    sides[-2:] = True  # the label, and whether any other voter fired
    trusted = np.zeros(votes.shape[1], bool)
    trusted[-2] = True
    model = fit_label_model(votes, 0.5 * (y == 1) + 0.45 * votes[:, -1], sides, trusted, weight=weight)
    return fit_linear(features, model.posterior, weight)


def score(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``df``; no shuffle of texts."""
    model = fit(df, labels, id_col, text_col, label_col)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        features = Features()

        def work(given: dict[str, list]) -> dict[str, list]:
            out = []
            for t in given["text"]:
                if model is None:
                    out.append(0.0)
                    continue
                f = features.of(t)
                z = float(model[0][np.fromiter(f, np.int64, len(f))].sum(dtype=np.float64)) + model[1]
                out.append(float(1 / (1 + np.exp(-min(max(z, -30), 30)))))
            return {"id": given["id"], "score": out}

        return work

    rows = map_rows(df, {"id": F.col(f"`{id_col}`"), "text": text(text_col)}, make, f"id {kind}, score double")
    return rows.select(
        "id",
        F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
