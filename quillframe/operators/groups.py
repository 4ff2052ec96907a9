"""Classes, groups and subgroups of a table against a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.support import as_doubles, present, rows_from_one, small_or_cut


def _known(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is neither NULL nor NaN."""
    known = present(target, df.schema[target].dataType)
    return df.withColumn(target, known).where(F.col(target).isNotNull())


def _class_counts(df: DataFrame, target: str) -> DataFrame:
    return (
        _known(df, target)
        .groupBy(F.col(target).alias("class"))
        .agg(F.count("*").alias("n"))
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, share)``."""
    counts = _class_counts(df, target)
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, weight)`` with weight ``rows / (classes * n)``."""
    counts = _class_counts(df, target)
    both = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.withColumn("weight", both["rows"] / (both["classes"] * F.col("n")))


def with_class_weight(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    weights = class_weights(df, target).select(
        F.col("class").alias(target), F.col("weight").alias(name)
    )
    return df.join(small_or_cut(weights), target)


def group_means(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """``(class, column_name, n, mean)`` for every class and column, one pass; rows without a class are left out."""
    columns = list(columns)
    means = [
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("n"), F.avg(c).alias("mean")
        ).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]
    data = as_doubles(_known(df, target), columns, [target])
    wide = data.groupBy(F.col(target).alias("class")).agg(*means)
    return wide.select("class", F.inline(F.array(*[f"m{i}" for i in range(len(columns))])))


def group_diff(df: DataFrame, in_group: Column, columns: Sequence[str]) -> DataFrame:
    """Means inside and outside a group and their difference relative to each.

    The two relative figures name their base, because a share of the smaller
    mean and a share of the larger one are easily mistaken for each other.
    """
    columns = list(columns)
    data = as_doubles(df, columns, [in_group.alias("__in")])
    inside, outside = F.col("__in"), ~F.col("__in")

    def compared(c: str) -> Column:
        a = F.avg(F.when(inside, F.col(c)))
        b = F.avg(F.when(outside, F.col(c)))
        return F.struct(
            F.lit(c).alias("column_name"),
            a.alias("mean_in"),
            b.alias("mean_out"),
            F.try_divide(a - b, b).alias("diff_to_out"),
            F.try_divide(a - b, a).alias("diff_to_in"),
        ).alias(c)

    one = data.agg(*[compared(c) for c in columns])
    return rows_from_one(one, [F.col(c) for c in columns])


def prevalence(df: DataFrame, target: str, dims: Sequence[str]) -> DataFrame:
    """``(dimension, value, n, positives, prevalence)`` of a 0/1 target, one job."""
    dims = list(dims)
    rows = df.select(
        present(target, df.schema[target].dataType).cast("double").alias("__y"),
        *[F.col(d).cast("string").alias(d) for d in dims],
    )
    return (
        rows.unpivot(["__y"], dims, "dimension", "value")
        .groupBy("dimension", "value")
        .agg(
            F.count("__y").alias("n"),
            F.sum("__y").cast("bigint").alias("positives"),
            F.avg("__y").alias("prevalence"),
        )
    )


def prevalence_spread(df: DataFrame, target: str, dims: Sequence[str]) -> DataFrame:
    """``(dimension, points, place)``: widest gap between subgroups first."""
    gap = F.max("prevalence") - F.min("prevalence")
    spread = (
        prevalence(df, target, dims).groupBy("dimension").agg((100 * gap).alias("points"))
    )
    # One row per dimension is left here, so ranking them is a single small task.
    return spread.withColumn("place", F.rank().over(W.orderBy(F.desc("points"))))
