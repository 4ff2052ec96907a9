"""Logistic regression by Newton steps: one scan a step, one small matrix to the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.support import as_doubles, present


@dataclass(frozen=True)
class NewtonModel:
    """Weights of standardised columns, the intercept first."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]


def _scaled(name: str, dtype, mean: float, deviation: float) -> Column:
    """A standardised column; a missing number counts as the mean, a constant column as nothing."""
    if not deviation:
        return F.lit(0.0)
    value = present(name, dtype).cast("double")
    return F.coalesce((value - F.lit(mean)) / F.lit(deviation), F.lit(0.0))


def fit_newton(
    df: DataFrame, target: str, columns: Sequence[str], steps: int = 8, ridge: float = 0.0
) -> NewtonModel:
    """Fit a 0/1 target by a fixed number of Newton steps from zero.

    Each step sums the weighted products of all pairs of columns and the slopes over
    the rows, batch by batch in the tasks; the driver solves a system as wide as the
    columns. Rows without a target take no part. ``ridge`` is added to the diagonal
    but for the intercept; columns that are constant keep the weight 0.
    """
    columns = list(columns)
    known = as_doubles(df, [target, *columns]).where(F.col(f"`{target}`").isNotNull())
    moments = known.agg(
        *[F.struct(F.avg(f"`{c}`").alias("m"), F.stddev_samp(f"`{c}`").alias("s")).alias(c) for c in columns]
    ).first()
    means = tuple(float(moments[c]["m"] or 0.0) for c in columns)
    deviations = tuple(float(moments[c]["s"] or 0.0) for c in columns)
    rows = known.select(
        F.col(f"`{target}`").alias("y"),
        *[
            _scaled(c, known.schema[c].dataType, m, s).alias(f"x{i}")
            for i, (c, m, s) in enumerate(zip(columns, means, deviations, strict=True))
        ],
    )
    size = len(columns) + 1
    weights = np.zeros(size)
    for _ in range(steps):
        products, slopes = _sums(rows, weights)
        products = products + ridge * np.diag([0.0, *[1.0] * len(columns)])
        live = np.flatnonzero(np.diag(products) > 0)
        if not len(live):
            break
        weights[live] += np.linalg.lstsq(products[np.ix_(live, live)], slopes[live], rcond=None)[0]
    return NewtonModel(tuple(columns), means, deviations, tuple(weights.tolist()))


def _sums(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted products of all pairs of columns, and the slopes, at ``weights``."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, slopes = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            y, *x = (np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns)
            x = np.column_stack([np.ones(len(y)), *x])
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -700, 700)))
            products += (x * (p * (1 - p))[:, None]).T @ x
            slopes += x.T @ (y - p)
        sums = np.concatenate([products.ravel(), slopes])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

    cells = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("cell", "part"))
    found = np.zeros(size * size + size)
    for r in cells.groupBy("cell").agg(F.sum("part").alias("total")).collect():
        found[r["cell"]] = r["total"]
    return found[: size * size].reshape(size, size), found[size * size :]


def with_newton_score(model: NewtonModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Rows with the probability of class 1, as a plain projection."""
    total: Column = F.lit(model.weights[0])
    for c, m, s, w in zip(model.columns, model.means, model.deviations, model.weights[1:], strict=True):
        total = total + F.lit(w) * _scaled(c, df.schema[c].dataType, m, s)
    return df.withColumn(name, 1 / (1 + F.exp(-total)))
