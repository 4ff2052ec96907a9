"""Pearson correlations, pairwise complete, for all pairs of columns in one scan.

Every task keeps one tile of co-moments: for each pair of columns the number of
rows that have both, their means and centred products. An Arrow batch adds to it
by a few matrix products of values and masks, so gaps cost nothing extra. Tiles
are small (a row per pair and task) and are merged pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.support import as_doubles, cut_lineage, numeric_columns, small_or_cut

# Rows, means and centred products of a pair, and the ranges that tell a constant exactly.
_CELLS = ("n", "mx", "my", "cxx", "cyy", "cxy", "lx", "hx", "ly", "hy")
_TILE = "i int, j int, " + ", ".join(f"{c} double" for c in _CELLS)


class Moments:
    """Co-moments of every column of ``x`` with every column of ``y``, over the rows that have both."""

    def __init__(self, columns_x: int, columns_y: int):
        shape = (columns_x, columns_y)
        self.n, self.mx, self.my = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.cxx, self.cyy, self.cxy = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.lx, self.ly = np.full(shape, np.inf), np.full(shape, np.inf)
        self.hx, self.hy = np.full(shape, -np.inf), np.full(shape, -np.inf)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows of ``x`` and ``y``, NaN where a value is missing."""
        batch = Moments(x.shape[1], y.shape[1])
        dx, has_x, at_x = _centred(x)
        dy, has_y, at_y = _centred(y)
        batch.n = has_x.T @ has_y
        some = np.maximum(batch.n, 1)
        sx, sy = dx.T @ has_y, has_x.T @ dy
        batch.mx, batch.my = at_x[:, None] + sx / some, at_y[None, :] + sy / some
        batch.cxx = np.maximum((dx * dx).T @ has_y - sx * sx / some, 0)
        batch.cyy = np.maximum(has_x.T @ (dy * dy) - sy * sy / some, 0)
        batch.cxy = dx.T @ dy - sx * sy / some
        batch.lx, batch.hx = _ranges(x, has_y)
        low, high = _ranges(y, has_x)
        batch.ly, batch.hy = low.T, high.T
        self.merge(batch)

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        dx, dy = other.mx - self.mx, other.my - self.my
        both = self.n * share
        self.cxx += other.cxx + dx * dx * both
        self.cyy += other.cyy + dy * dy * both
        self.cxy += other.cxy + dx * dy * both
        self.mx += dx * share
        self.my += dy * share
        self.n = n
        for low, high in (("lx", "hx"), ("ly", "hy")):
            setattr(self, low, np.minimum(getattr(self, low), getattr(other, low)))
            setattr(self, high, np.maximum(getattr(self, high), getattr(other, high)))


def _ranges(x: np.ndarray, has_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of each column of ``x`` over the rows that each column of ``y`` has."""
    low, high = np.empty((x.shape[1], has_y.shape[1])), np.empty((x.shape[1], has_y.shape[1]))
    whole = None
    for j in range(has_y.shape[1]):
        rows = has_y[:, j] > 0
        if rows.all():
            whole = whole or _ends(x)
            low[:, j], high[:, j] = whole
        else:
            low[:, j], high[:, j] = _ends(x[rows])
    return low, high


def _ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.fmin.reduce(x, axis=0, initial=np.inf), np.fmax.reduce(x, axis=0, initial=-np.inf)


def _centred(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations from a centre (0 where missing), the mask of values, and the centre.

    The centre is the mean, kept within the range.
    """
    has = ~np.isnan(values)
    filled = np.where(has, values, 0.0)
    mean = filled.sum(axis=0) / np.maximum(has.sum(axis=0), 1)
    low, high = _ends(values)
    centre = np.where(low <= high, np.clip(mean, low, high), 0.0)
    return np.where(has, values - centre, 0.0), has.astype(float), centre


def _tiles(data: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The tile of each task, a row per pair of a left and a right column that occur together."""
    columns = list(dict.fromkeys([*left, *right]))
    x, y = [columns.index(c) for c in left], [columns.index(c) for c in right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = Moments(len(x), len(y))
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                if batch.num_rows:
                    values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                    tile.add(values[:, x], values[:, y])
        for i in range(len(x)):
            j = np.flatnonzero(tile.n[i])
            if len(j):
                arrays = [np.full(len(j), i, np.int32), j.astype(np.int32), *[getattr(tile, c)[i, j] for c in _CELLS]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["i", "j", *_CELLS])

    return data.select(*columns).mapInArrow(run, _TILE)


def _pairs(data: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(a, b, r)`` for the given pairs, NULL where a column is constant; one scan of ``data``."""
    spark = data.sparkSession
    left, right = list(dict.fromkeys(a for a, _ in pairs)), list(dict.fromkeys(b for _, b in pairs))
    asked = [(left.index(a), right.index(b), a, b) for a, b in pairs]
    named = spark.createDataFrame(asked, "i int, j int, a string, b string")
    if not pairs:
        return named.select("a", "b", F.lit(None).cast("double").alias("r"))
    # The tiles are read twice; writing them keeps the table itself at one scan.
    tiles = cut_lineage(_tiles(data, left, right))
    origin = tiles.groupBy("i", "j").agg(F.min("mx").alias("ox"), F.min("my").alias("oy"))
    # Means as differences to the least one, which keeps their digits.
    dx, dy = F.col("mx") - F.col("ox"), F.col("my") - F.col("oy")
    n = F.col("n")
    summed = tiles.join(small_or_cut(origin), ["i", "j"]).groupBy("i", "j").agg(
        F.sum(n).alias("n"), F.sum(n * dx).alias("sx"), F.sum(n * dy).alias("sy"),
        F.sum(F.col("cxx") + n * dx * dx).alias("qxx"), F.sum(F.col("cyy") + n * dy * dy).alias("qyy"),
        F.sum(F.col("cxy") + n * dx * dy).alias("qxy"),
        ((F.min("lx") < F.max("hx")) & (F.min("ly") < F.max("hy"))).alias("varied"),
    )
    cxx = F.col("qxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("qyy") - F.col("sy") * F.col("sy") / n
    cxy = F.col("qxy") - F.col("sx") * F.col("sy") / n
    spread = F.sqrt(F.greatest(cxx, F.lit(0.0))) * F.sqrt(F.greatest(cyy, F.lit(0.0)))
    r = F.when(F.col("varied") & (spread > 0), F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(cxy / spread))
    return named.join(summed, ["i", "j"], "left").select("a", "b", r.alias("r"))


def corr_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(a, b, r)`` for every unordered pair of numeric columns."""
    columns = numeric_columns(df) if columns is None else list(columns)
    return _pairs(as_doubles(df, columns), list(combinations(columns, 2)))


def corr_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full symmetric matrix in long form; a constant column has no diagonal.

    Every computed pair gives both its cells, so the table is read once.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    data = as_doubles(df, columns)
    diagonal = [(c, c) for c in columns]
    both = F.array(
        F.struct(F.col("a").alias("a"), F.col("b").alias("b")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b")),
    )
    cells = _pairs(data, list(combinations(columns, 2)) + diagonal)
    return cells.select("r", F.inline(F.array_distinct(both))).select("a", "b", "r")


def top_corr_pair(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The pair with the largest absolute correlation."""
    return (
        corr_pairs(df, columns)
        .where("r IS NOT NULL")
        .orderBy(F.desc(F.abs("r")), "a", "b")
        .limit(1)
    )


def scatter_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Every complete point of two columns once, with how often it occurs."""
    return (
        as_doubles(df, [x, y])
        .where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(x, y)
        .agg(F.count("*").alias("n"))
    )


def scatter_sample(
    df: DataFrame, x: str, y: str, k: int = 1000, seed: int = 0, hashed: Column | None = None
) -> DataFrame:
    """``(x, y, n)`` of ``k`` distinct complete points at most, chosen by a seeded hash.

    A bottom-k sketch: every task keeps the k points of least hash it has seen, and the least
    k of these are the least k of all. The same points come out however the table is cut.
    ``n`` counts the rows of each; ``hashed`` replaces the hash of the two values, of which a
    tie goes to the smaller point.
    """
    if hashed is None:
        hashed = F.xxhash64(F.lit(seed), F.col(x), F.col(y))
    # Equal points fall together before the shuffle, and the limit keeps k rows a task.
    return (
        scatter_points(df, x, y)
        .withColumn("__h", hashed)
        .orderBy("__h", x, y)
        .limit(k)
        .drop("__h")
    )


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """``(x_bin, y_bin, x_lo, x_hi, y_lo, y_hi, n)``: a chart of bins by bins cells, the empty ones left out.

    However many points there are, at most ``bins * bins`` rows are shuffled a task.
    """
    # Imported here, as charts has the numbers of all charts but these.
    from quillframe.operators.charts import _bin, _edges

    data = as_doubles(df, [x, y]).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = data.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    edges = {"x": _edges(ends[0], ends[1], bins), "y": _edges(ends[2], ends[3], bins)}
    placed = data.select(_bin(F.col(x), edges["x"]).alias("x_bin"), _bin(F.col(y), edges["y"]).alias("y_bin"))
    counts = placed.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))

    def edge(axis: str, shift: int) -> Column:
        return F.get(F.array(*[F.lit(e) for e in edges[axis]]), F.col(f"{axis}_bin") - 1 + shift)

    return counts.select(
        "x_bin", "y_bin", edge("x", 0).alias("x_lo"), edge("x", 1).alias("x_hi"),
        edge("y", 0).alias("y_lo"), edge("y", 1).alias("y_hi"), "n",
    )


def target_correlations(
    df: DataFrame, target: str, features: Sequence[str] | None = None
) -> DataFrame:
    """``(feature, r)`` of each numeric feature with the target."""
    if features is None:
        features = [c for c in numeric_columns(df) if c != target]
    data = as_doubles(df, [*features, target])
    found = _pairs(data, [(f, target) for f in features])
    return found.select(F.col("a").alias("feature"), "r")


def top_features(
    df: DataFrame, target: str, k: int = 5, features: Sequence[str] | None = None
) -> DataFrame:
    """The ``k`` numeric features most correlated with the target, in absolute value."""
    return (
        target_correlations(df, target, features)
        .where("r IS NOT NULL")
        .orderBy(F.desc(F.abs("r")), "feature")
        .limit(k)
    )
