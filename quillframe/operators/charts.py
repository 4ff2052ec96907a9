"""The numbers behind charts: histograms, box plots, outliers, the chart quota."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V
from quillframe.operators.quantiles import (
    QUARTILES, STATE_VALUES, approx_distinct, counts_of, exact_quantiles, ranked_counts,
)
from quillframe.support import as_doubles, cut_lineage, join_side, numeric_columns, rows_from_one


def _edges(lo: float | None, hi: float | None, bins: int) -> list[float]:
    if lo is None:
        lo, hi = 0.0, 1.0
    elif lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    return [i * step + lo for i in range(bins)] + [hi]


def _bin(value: Column, edges: list[float]) -> Column:
    """Number from 1 of the bin with ``edge <= value < next edge``; the last is closed.

    The arithmetic guess can be off by one at an edge, so it is checked against
    the edges themselves.
    """
    bins, lo, hi = len(edges) - 1, edges[0], edges[-1]
    guess = F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    edge = F.array(*[F.lit(e) for e in edges])
    return (
        F.when(value < F.get(edge, guess), guess)
        .when((value >= F.get(edge, guess + 1)) & (guess < bins - 1), guess + 2)
        .otherwise(guess + 1)
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """``(column_name, bin, lo, hi, n)`` in equal widths, empty bins included."""
    columns = list(columns)
    data = as_doubles(df, columns)
    ends = data.agg(
        *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]
    ).first()
    edges = {c: _edges(ends[c]["lo"], ends[c]["hi"], bins) for c in columns}
    placed = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), _bin(F.col(c), edges[c]).alias("bin"))
            for c in columns
        ]
    )
    counts = (
        data.select(F.inline(placed))
        .where("bin IS NOT NULL")
        .groupBy("column_name", "bin")
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.createDataFrame(
        [(c, i + 1, e[i], e[i + 1]) for c, e in edges.items() for i in range(bins)],
        "column_name string, bin int, lo double, hi double",
    )
    # Both sides hold one row per bin at most.
    return grid.join(F.broadcast(counts), ["column_name", "bin"], "left").fillna(0, ["n"])


def box_by_group(
    df: DataFrame, value: str, by: str, state_values: int = STATE_VALUES
) -> DataFrame:
    """Box-plot figures per group.

    ``(by, n, q1, median, q3, whisker_lo, whisker_hi, n_outside)``; whiskers end
    at the last values within 1.5 interquartile ranges of the box.
    """
    data = as_doubles(df, [value], [by]).where(F.col(value).isNotNull())
    if approx_distinct(data, [value], [by])[value] <= state_values:
        # Value counts give the box and, without the rows, what lies outside it.
        counts = cut_lineage(counts_of(data, [value], [by]))
        boxes = ranked_counts(counts, QUARTILES, [by])
        rows = counts.select(by, F.col("value").alias(value), "times")
    else:
        boxes = exact_quantiles(data, [value], QUARTILES, [by], state_values, {value: state_values + 1})
        rows = data.withColumn("times", F.lit(1))
    boxes = boxes.select(
        by, "n",
        F.get("q", F.lit(0)).alias("q1"),
        F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        join_side(rows, boxes, [by])
        .groupBy(by, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(near, F.col(value))).alias("near_lo"),
            F.max(F.when(near, F.col(value))).alias("near_hi"),
            F.sum(F.when(near, 0).otherwise(F.col("times"))).cast("long").alias("n_outside"),
        )
        .select(
            by, "n", "q1", "median", "q3",
            F.least("near_lo", "q1").alias("whisker_lo"),
            F.greatest("near_hi", "q3").alias("whisker_hi"),
            "n_outside",
        )
    )


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], state_values: int = STATE_VALUES
) -> dict[str, tuple[float, float] | None]:
    """1.5 IQR bounds per column, on the driver: one small row per column."""
    rows = exact_quantiles(df, columns, QUARTILES, state_values=state_values).collect()
    bounds: dict[str, tuple[float, float] | None] = dict.fromkeys(columns)
    for row in rows:
        if row["q"] is not None:
            q1, _, q3 = row["q"]
            bounds[row["column_name"]] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return bounds


def outlier_counts(column: str, bounds: tuple[float, float] | None) -> tuple[Column, Column]:
    """Aggregates counting values below and above the bounds."""
    if bounds is None:
        return F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    return F.count_if(F.col(column) < bounds[0]), F.count_if(F.col(column) > bounds[1])


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, state_values: int = STATE_VALUES
) -> DataFrame:
    """``(column_name, lo, hi, n_below, n_above, n_outliers, note)``, all columns at once."""
    columns = numeric_columns(df) if columns is None else list(columns)
    bounds = iqr_bounds(df, columns, state_values)

    def counted(c: str) -> Column:
        lo, hi = bounds[c] or (None, None)
        below, above = outlier_counts(c, bounds[c])
        return F.struct(
            F.lit(c).alias("column_name"),
            F.lit(lo).cast("double").alias("lo"),
            F.lit(hi).cast("double").alias("hi"),
            below.alias("n_below"),
            above.alias("n_above"),
            (below + above).alias("n_outliers"),
            F.when(below + above == 0, F.lit(V.NOTHING_FOUND)).otherwise(F.lit("")).alias("note"),
        ).alias(c)

    one = as_doubles(df, columns).agg(F.count("*").alias("__n"), *[counted(c) for c in columns])
    return rows_from_one(one, [F.col(c) for c in columns])


def chart_quota(specs: DataFrame, run: str, order: str, limit: int = V.MAX_CHARTS) -> DataFrame:
    """The first ``limit`` chart specs of every run.

    Spark keeps at most ``limit`` rows per run in each task before the shuffle,
    so a run of any length stays cheap.
    """
    place = F.row_number().over(W.partitionBy(run).orderBy(order))
    return specs.withColumn("place", place).where(F.col("place") <= limit)
