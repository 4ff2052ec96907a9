"""Exact interpolated quantiles, whole table or per group, at any size.

Columns with a bounded number of distinct values, which one cheap pass measures,
are reduced to value counts, and the counts are ranked.

Beyond the bound ranks are found by radix selection. A double's bits are read as
a whole number of the same order. Rows are counted by group and the first bits of
that number; the bucket that holds a wanted rank is counted again by the next bits,
for all groups, columns and ranks at once. Four rounds fix all 64 bits, however many
groups there are; once few rows are left in the buckets, one round counts the rest.
No task ever holds a column or a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.support import as_doubles, cut_lineage, join_side

QUARTILES = (0.25, 0.5, 0.75)
# Most distinct values, over all groups, that one task may have to order.
STATE_VALUES = 1_000_000
# The bits of the ordered number left to the later rounds; each round tells 16 more apart.
_SHIFTS = (48, 32, 16, 0)


def approx_distinct(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> dict[str, int]:
    """Distinct values per column, or distinct pairs of group and value."""
    def counted(c: str) -> Column:
        return F.approx_count_distinct(F.struct(*by, c) if by else F.col(c)).alias(c)

    return df.agg(*[counted(c) for c in columns]).first().asDict()


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    by: Sequence[str] = (),
    state_values: int = STATE_VALUES,
    distinct: dict[str, int] | None = None,
) -> DataFrame:
    """Rows ``(*by, column_name, n, q)`` with ``q`` as one array per column.

    Missing values are left out; interpolation is linear between the two
    nearest ranks. ``distinct`` passes in counts measured earlier.
    """
    columns, by, probs = list(columns), list(by), list(probs)
    data = as_doubles(df, columns, by)
    seen = approx_distinct(data, columns, by) if distinct is None else distinct
    counted = [c for c in columns if seen[c] <= state_values]
    narrowed = [c for c in columns if seen[c] > state_values]
    parts = []
    if counted:
        parts.append(ranked_counts(counts_of(data, counted, by), probs, by))
    if narrowed:
        parts.append(_by_radix(data, narrowed, probs, by, state_values))
    return reduce(DataFrame.unionByName, parts)


def _at_rank(rank: Column) -> Column:
    """As an aggregate, the value whose run of equal values covers the rank."""
    covers = (F.col("start") <= rank) & (rank < F.col("end"))
    return F.max(F.when(covers, F.col("value")))


def _between(low: Column, high: Column, rank: Column) -> Column:
    return low + (rank - F.floor(rank)) * (high - low)


def _long(data: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    return data.unpivot(by, columns, "column_name", "value").where("value IS NOT NULL")


def counts_of(data: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """``(*by, column_name, value, times)``; counts combine before and across the shuffle."""
    return _long(data, columns, by).groupBy(*by, "column_name", "value").agg(F.count("*").alias("times"))


def ranked_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The quantiles of value counts as of `counts_of`."""
    group = [*by, "column_name"]
    whole = W.partitionBy(*group)
    upto = whole.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumns(
        {"end": F.sum("times").over(upto), "n": F.sum("times").over(whole)}
    ).withColumn("start", F.col("end") - F.col("times"))
    ranks = [F.lit(p) * (F.col("n") - 1) for p in probs]
    found = placed.groupBy(*group, "n").agg(
        *[_at_rank(F.floor(r)).alias(f"lo{i}") for i, r in enumerate(ranks)],
        *[_at_rank(F.ceil(r)).alias(f"hi{i}") for i, r in enumerate(ranks)],
    )
    values = [_between(F.col(f"lo{i}"), F.col(f"hi{i}"), r) for i, r in enumerate(ranks)]
    return found.select(*group, "n", F.array(*values).alias("q"))


def _ordered(value: Column) -> Column:
    """The bits of a double as a whole number that sorts as the double does."""

    @F.pandas_udf("long")
    def ordered(values: pd.Series) -> pd.Series:
        # Adding zero makes one of the two zeros.
        bits = (values.to_numpy(dtype="float64") + 0.0).view("int64")
        return pd.Series(bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF))

    return ordered(value)


def _value(number: Column) -> Column:
    """The double of an ordered number."""

    @F.pandas_udf("double")
    def value(numbers: pd.Series) -> pd.Series:
        bits = numbers.to_numpy(dtype="int64")
        return pd.Series((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))

    return value(number)


def _hit(rows: DataFrame, within: list[str], keep: list[str]) -> DataFrame:
    """The buckets that hold a wanted rank, from counts with ``below``, ``ranks`` and ``bucket``."""
    upto = W.partitionBy(*within).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("below") + F.sum("times").over(upto)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("times"))
    mine = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("end")))
    return placed.select(
        *keep, F.col("bucket").alias("prefix"), F.col("start").alias("below"), F.col("times").alias("inside"),
        mine.alias("ranks"),
    ).where(F.size("ranks") > 0)


def _by_radix(
    data: DataFrame, columns: list[str], probs: list[float], by: list[str], state_values: int
) -> DataFrame:
    group = [*by, "column_name"]
    rows = _long(data, columns, by).select(*group, _ordered(F.col("value")).alias("number"))
    first = rows.groupBy(*group, F.shiftright("number", _SHIFTS[0]).alias("bucket")).agg(F.count("*").alias("times"))
    first = first.withColumn("n", F.sum("times").over(W.partitionBy(*group)))
    ranks = F.array_distinct(
        F.array(*[f(F.lit(p) * (F.col("n") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    )
    first = first.withColumns({"ranks": ranks, "below": F.lit(0).cast("long")})
    slots = cut_lineage(_hit(first, group, [*group, "n"]))
    was = _SHIFTS[0]
    while was:
        # Few rows left in all buckets: the next round may tell all values apart.
        left = slots.agg(F.sum("inside")).first()[0] or 0
        shift = 0 if left <= state_values else was - 16
        aside = slots.select(*group, "prefix")
        inside = join_side(rows.withColumn("prefix", F.shiftright("number", was)), aside, [*group, "prefix"])
        level = inside.groupBy(*group, "prefix", F.shiftright("number", shift).alias("bucket"))
        level = join_side(level.agg(F.count("*").alias("times")), slots.drop("inside"), [*group, "prefix"])
        slots = cut_lineage(_hit(level, [*group, "prefix"], [*group, "n"]))
        was = shift
    found = slots.select(*group, "n", F.explode("ranks").alias("rank"), _value(F.col("prefix")).alias("value"))
    # Two ranks a probability at most.
    known = found.groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def quantile(p: float) -> Column:
        rank = F.lit(p) * (F.col("n") - 1)
        low, high = [F.element_at("at", f(rank).cast("long")) for f in (F.floor, F.ceil)]
        return _between(low, high, rank)

    return known.select(*group, "n", F.array(*[quantile(p) for p in probs]).alias("q"))
