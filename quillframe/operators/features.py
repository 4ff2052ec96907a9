"""Preparing features: selection, encoding, scaling, interactions, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.operators.correlation import corr_pairs, target_correlations
from quillframe.operators.groups import prevalence_spread
from quillframe.operators.profile import column_roles
from quillframe.support import as_doubles, numbered, present, small_or_cut

# Most categories that become columns of their own.
MAX_CATEGORIES = 1_000


def feature_select(
    df: DataFrame,
    target: str,
    collinear: float = 0.95,
    weak_points: float = 2.0,
    weak_r: float = 0.01,
) -> DataFrame:
    """``(column_name, role, keep, reason)`` for every column but the target.

    Dropped are technical columns, the later column of a collinear pair, numbers
    hardly correlated with the target and categories or flags whose subgroups
    hardly differ in it. All lists are as long as the schema.
    """
    features = df.drop(target)
    roles = {r["column_name"]: r["role"] for r in column_roles(features).collect()}
    numbers = [c for c, role in roles.items() if role == "numeric"]
    dims = [c for c, role in roles.items() if role in ("categorical", "binary")]

    reasons = {c: "technical" for c, role in roles.items() if role == "technical"}
    if len(numbers) > 1:
        for row in corr_pairs(df, numbers).collect():
            a, b, r = row["a"], row["b"], row["r"]
            if r is not None and abs(r) >= collinear and a not in reasons:
                reasons.setdefault(b, "collinear")
    if numbers:
        for row in target_correlations(df, target, numbers).collect():
            if row["r"] is None or abs(row["r"]) < weak_r:
                reasons.setdefault(row["feature"], "weak")
    if dims:
        for row in prevalence_spread(df, target, dims).collect():
            if row["points"] is None or row["points"] < weak_points:
                reasons.setdefault(row["dimension"], "weak")
    return df.sparkSession.createDataFrame(
        [(c, roles[c], c not in reasons, reasons.get(c, "")) for c in features.columns],
        "column_name string, role string, keep boolean, reason string",
    )


def one_hot(df: DataFrame, column: str, categories: Sequence[str] | None = None) -> DataFrame:
    """Add a 0/1 column ``<column>_<value>`` per category, in value order.

    With more than ``MAX_CATEGORIES`` values this raises; use ``one_hot_vector`` there.
    """
    if categories is None:
        seen = df.where(F.col(column).isNotNull()).select(column).distinct()
        found = [r[0] for r in seen.take(MAX_CATEGORIES + 1)]
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{column} has more than {MAX_CATEGORIES} values")
        categories = sorted(found)
    flags = {
        f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0))
        for v in categories
    }
    return df.withColumns(flags)


def category_numbers(df: DataFrame, column: str) -> DataFrame:
    """``(column, number)``: every value but NULL, numbered from 0 in value order.

    Values are sorted by ranges; the driver sees one count a range, never the values.
    """
    seen = df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`")).distinct()
    return numbered(seen, [F.col(f"`{column}`")])


def _joined_numbers(df: DataFrame, column: str, numbers: DataFrame, name: str) -> DataFrame:
    side = small_or_cut(numbers.select(F.col(f"`{column}`").alias("__value"), F.col("number").alias(name)))
    return df.join(side, F.col(f"`{column}`") == F.col("__value"), "left").drop("__value")


def with_category_number(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add the value's number of ``category_numbers``; NULL stays NULL."""
    return _joined_numbers(df, column, category_numbers(df, column), name or f"{column}_number")


def one_hot_vector(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add a sparse vector with a 1 at the value's number, for any number of values; all 0 for NULL."""
    numbers = category_numbers(df, column)
    size = numbers.count()
    rows = _joined_numbers(df, column, numbers, "__number")
    rows = rows.withColumn("__number", F.coalesce("__number", F.lit(size)).cast("double"))
    # The encoder only has to know the largest number; the last one, that of NULL, has no place.
    largest = df.sparkSession.createDataFrame([(float(size),)], "__number double")
    encoder = OneHotEncoder(inputCol="__number", outputCol=name or f"{column}_vector").fit(largest)
    return encoder.transform(rows).drop("__number")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by ``(x - mean) / std``; a constant column becomes NULL.

    Moments are one aggregate, fetched as one row, so the scaling itself is a
    plain projection.
    """
    columns = list(columns)
    data = as_doubles(df, columns)
    moments = data.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns]
    ).first()
    scaled = {}
    for c in columns:
        mean, std = moments[c]["mean"], moments[c]["std"]
        value = (present(c, df.schema[c].dataType).cast("double") - F.lit(mean)) / F.lit(std)
        scaled[c] = value if std else F.lit(None).cast("double")
    return df.withColumns(scaled)


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Add the product ``a_x_b`` of each pair."""
    number = {
        c: present(c, df.schema[c].dataType).cast("double") for pair in pairs for c in pair
    }
    return df.withColumns({f"{a}_x_{b}": number[a] * number[b] for a, b in pairs})


def stratified_split(
    df: DataFrame,
    target: str,
    key: str,
    test_share: float = 0.2,
    hashed: Column | None = None,
    slices: int = 65_536,
) -> DataFrame:
    """Add ``part``: test for the ``floor(share * n)`` smallest hashes per class.

    Exact and repeatable without ordering a class as a whole. Counts per class
    and hash slice show in which slice the border lies, counts per hash in that slice
    at which hash. Only rows of that one hash are put in order, by ranges, to find the
    border row, and the rows are then compared with it in place.
    ``hashed`` gives whole numbers in [0, 2**31); ties are broken by ``key``.
    """
    if hashed is None:
        hashed = F.pmod(F.xxhash64(key), F.lit(2**31))
    width = 2**31 // slices
    rows = df.withColumn("__h", hashed.cast("bigint"))
    marks = rows.select(
        F.col(target).alias("__class"), F.col(key).alias("__key"), "__h",
        F.floor(F.col("__h") / width).alias("__slice"),
    )
    borders = small_or_cut(_borders(marks, test_share))
    in_test = F.struct(F.col("__h"), F.col(key).alias("__key")) <= F.col("__border")
    return (
        rows.join(borders, F.col(target).eqNullSafe(F.col("__class")), "left")
        .withColumn("part", F.when(in_test, "test").otherwise("train"))
        .drop("__h", "__class", "__border")
    )


def _crossing(counts: DataFrame, by: str) -> DataFrame:
    """``(__class, by, place)``: where the running count reaches ``wanted``, and the place there, from 1."""
    upto = W.partitionBy("__class").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.withColumn("upto", F.sum("n").over(upto))
        .where("wanted > upto - n AND wanted <= upto")
        .selectExpr("__class", by, "wanted - upto + n AS place")
    )


def _rows_at(marks: DataFrame, at: DataFrame, by: str) -> DataFrame:
    """The rows of ``marks`` at the class and the ``by`` of ``at``, with its place."""
    side = small_or_cut(at.withColumnsRenamed({"__class": "__c", by: "__by"}))
    same = F.col("__class").eqNullSafe(F.col("__c")) & (F.col(by) == F.col("__by"))
    return marks.join(side, same).drop("__c", "__by")


def _borders(marks: DataFrame, share: float) -> DataFrame:
    """Per class the last (hash, key) of the test part; no row when that is empty."""
    wanted = F.floor(F.sum("n").over(W.partitionBy("__class")) * F.lit(share))
    by_slice = marks.groupBy("__class", "__slice").agg(F.count("*").alias("n"))
    in_slice = _rows_at(marks, _crossing(by_slice.withColumn("wanted", wanted), "__slice"), "__slice")
    by_hash = in_slice.groupBy("__class", "__h").agg(F.count("*").alias("n"), F.max("place").alias("wanted"))
    tied = _rows_at(marks, _crossing(by_hash, "__h"), "__h")
    ranked = numbered(tied, [F.col("__class"), F.col("__key")])
    # Numbers go on from class to class: the border row is ``place`` rows after its class begins.
    begins = small_or_cut(ranked.groupBy(F.col("__class").alias("__c")).agg(F.min("number").alias("begin")))
    return (
        ranked.join(begins, F.col("__class").eqNullSafe(F.col("__c")))
        .where("number = begin + place - 1")
        .select("__class", F.struct("__h", "__key").alias("__border"))
    )
