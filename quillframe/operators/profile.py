"""Whole-table profile: shape, types, missing cells, describe, counts, roles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import fixed_values as V
from quillframe.operators.quantiles import QUARTILES, STATE_VALUES, exact_quantiles
from quillframe.support import (
    as_doubles,
    nan_to_null,
    numeric_columns,
    present,
    rows_from_one,
    text_columns,
)

# Column type names shown in a schema block.
_TYPE_NAMES = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "float": "float32", "double": "float64", "boolean": "bool",
    "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]",
}


def shape(df: DataFrame) -> DataFrame:
    width = F.lit(len(df.columns)).cast("bigint")
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", width)


def schema_rows(df: DataFrame) -> list[tuple[int, str, str]]:
    return [
        (i, f.name, _TYPE_NAMES.get(f.dataType.simpleString(), "object"))
        for i, f in enumerate(df.schema)
    ]


def schema_block(df: DataFrame) -> DataFrame:
    """One row ``(block)``: size line, then name and type of every column."""
    before, after = V.SCHEMA_SIZE.replace("{cols}", str(len(df.columns))).split("{rows}")
    listed = [V.SCHEMA_COLUMNS] + [f"  - {name}: {kind}" for _, name, kind in schema_rows(df)]
    return df.agg(
        F.concat(
            F.lit(before),
            F.count("*").cast("string"),
            F.lit("\n".join([after, *listed])),
        ).alias("block")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_missing)``; NULL and NaN both count."""
    missing = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.count_if(present(f.name, f.dataType).isNull()).alias("n_missing"),
        ).alias(f"c{i}")
        for i, f in enumerate(df.schema)
    ]
    return rows_from_one(df.agg(*missing), [F.col(f"c{i}") for i in range(len(missing))])


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    state_values: int = STATE_VALUES,
) -> DataFrame:
    """``(column_name, n, mean, std, min, q25, q50, q75, max)``, percentiles exact.

    Two passes: one for the moments and the distinct counts that choose how the
    quantiles are computed, one for the quantiles.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    data = as_doubles(df, columns)
    measures = {
        "n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "values": F.approx_count_distinct,
    }
    row = data.agg(
        *[
            F.struct(*[f(c).alias(m) for m, f in measures.items()]).alias(c)
            for c in columns
        ]
    ).first()
    stats = df.sparkSession.createDataFrame(
        [(c, row[c]["n"], row[c]["mean"], row[c]["std"], row[c]["min"], row[c]["max"])
         for c in columns],
        "column_name string, n bigint, mean double, std double, min double, max double",
    )
    quartiles = exact_quantiles(
        df, columns, QUARTILES, state_values=state_values,
        distinct={c: row[c]["values"] for c in columns},
    ).drop("n")
    return F.broadcast(stats).join(quartiles, "column_name", "left").select(
        "column_name", "n", "mean", "std", "min",
        F.get("q", F.lit(0)).alias("q25"),
        F.get("q", F.lit(1)).alias("q50"),
        F.get("q", F.lit(2)).alias("q75"),
        "max",
    )


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, value, n)`` for all text columns in one job, most frequent first."""
    columns = text_columns(df) if columns is None else list(columns)
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], columns, "column_name", "value")
        .where("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
        .orderBy("column_name", F.desc("n"), "value")
    )


def column_roles(df: DataFrame) -> DataFrame:
    """``(column_name, role)``: numeric, categorical, binary, technical or other.

    Numbers that are all 0 or 1 are binary. A whole-number or text column whose
    values never repeat is technical: a sketch picks the candidates and only
    those are checked exactly, all in one shuffle. Other text is categorical.
    """
    data = nan_to_null(df)

    def in_01(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.NumericType):
            return F.count_if(~F.col(f.name).isin(0, 1))
        return F.lit(None).cast("bigint")

    row = data.agg(
        *[
            F.struct(
                F.count(f.name).alias("n"),
                F.approx_count_distinct(f.name).alias("values"),
                in_01(f).alias("beyond_01"),
            ).alias(f.name)
            for f in data.schema
            if isinstance(f.dataType, T.AtomicType)
        ],
        F.count("*").alias("__rows"),
    ).first()
    roles = {f.name: _role(f, row) for f in data.schema}
    repeating = _repeating(data, [f for f in data.schema if roles[f.name] == "technical"])
    for f in repeating:
        roles[f.name] = "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
    return df.sparkSession.createDataFrame(list(roles.items()), "column_name string, role string")


def _repeating(
    data: DataFrame, fields: list[T.StructField], digest: Callable[[Column], Column] = F.xxhash64
) -> list[T.StructField]:
    """Those of ``fields``, which have no gaps, where some value occurs twice.

    All columns go through one shuffle of (column, 64 bits): a whole number by itself,
    a text by its digest. Where digests repeat, one of them is looked up; should its
    texts differ, that column alone is grouped by its texts.
    """
    if not fields:
        return []

    def bits(f: T.StructField) -> Column:
        col = F.col(f"`{f.name}`")
        return digest(col) if isinstance(f.dataType, T.StringType) else col.cast("bigint")

    cells = [F.struct(F.lit(i).alias("i"), bits(f).alias("h")) for i, f in enumerate(fields)]
    counts = data.select(F.inline(F.array(*cells))).groupBy("i", "h").agg(F.count("*").alias("n"))
    twice = {r["i"]: r["h"] for r in counts.where("n > 1").groupBy("i").agg(F.min("h").alias("h")).collect()}
    texts = [i for i in twice if isinstance(fields[i].dataType, T.StringType)]
    if not texts:
        return [fields[i] for i in sorted(twice)]
    looked_up = [
        F.struct(
            F.lit(i).alias("i"),
            F.when(bits(fields[i]) == twice[i], F.col(f"`{fields[i].name}`")).alias("value"),
        )
        for i in texts
    ]
    found = data.select(F.inline(F.array(*looked_up))).where("value IS NOT NULL")
    same = found.groupBy("i", "value").agg(F.count("*").alias("n")).where("n > 1").select("i").distinct()
    sure = {r["i"] for r in same.collect()}
    for i in set(texts) - sure:
        values = data.groupBy(f"`{fields[i].name}`").agg(F.count("*").alias("__n"))
        if values.where("__n > 1").isEmpty():
            del twice[i]
    return [fields[i] for i in sorted(twice)]


def _role(f: T.StructField, row) -> str:
    """The role, with every candidate for a key taken as technical."""
    if isinstance(f.dataType, T.BooleanType):
        return "binary"
    keyable = isinstance(f.dataType, (T.IntegralType, T.StringType))
    numeric = isinstance(f.dataType, T.NumericType)
    if not (keyable or numeric):
        return "other"
    seen = row[f.name]
    if numeric and seen["beyond_01"] == 0 and 0 < seen["n"] and seen["values"] <= 2:
        return "binary"
    if keyable and seen["n"] == row["__rows"] > 0 and seen["values"] >= 0.8 * seen["n"]:
        return "technical"
    return "numeric" if numeric else "categorical"


def threshold_counts(df: DataFrame, rules: Sequence[tuple[str, float]]) -> DataFrame:
    """``(column_name, threshold, n_above)`` with a strict ``>``, all rules in one pass."""
    counted = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(float(limit)).alias("threshold"),
            F.count_if(present(c, df.schema[c].dataType) > limit).alias("n_above"),
        ).alias(f"r{i}")
        for i, (c, limit) in enumerate(rules)
    ]
    return rows_from_one(df.agg(*counted), [F.col(f"r{i}") for i in range(len(counted))])


def band(value: Column, bands: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Name of the first band with ``lo <= value < hi``; an open end is None."""
    named = F.lit(None).cast("string")
    for name, lo, hi in reversed(list(bands)):
        above = F.lit(True) if lo is None else value >= lo
        under = F.lit(True) if hi is None else value < hi
        named = F.when(value.isNotNull() & above & under, F.lit(name)).otherwise(named)
    return named


def band_counts(
    df: DataFrame, bands: dict[str, Sequence[tuple[str, float | None, float | None]]]
) -> DataFrame:
    """``(column_name, band, n, min, max)`` for every column that has a bounds table."""
    columns = list(bands)
    data = as_doubles(df, columns)
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                band(F.col(c), bands[c]).alias("band"),
                F.col(c).alias("value"),
            )
            for c in columns
        ]
    )
    return (
        data.select(F.inline(pairs))
        .where("band IS NOT NULL")
        .groupBy("column_name", "band")
        .agg(
            F.count("*").alias("n"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def range_truncation(df: DataFrame, plausible: dict[str, tuple[float, float]]) -> DataFrame:
    """Observed range against the plausible one; strictly inside at an end is suspect."""
    def judged(c: str) -> Column:
        lo, hi = plausible[c]
        return F.struct(
            F.lit(c).alias("column_name"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            (F.min(c) > lo).alias("cut_below"),
            (F.max(c) < hi).alias("cut_above"),
        ).alias(c)

    columns = list(plausible)
    one = as_doubles(df, columns).agg(*[judged(c) for c in columns])
    return rows_from_one(one, [F.col(c) for c in columns])


def identity_residual(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """How far ``left = right`` fails to hold: residual mean and deviation, r squared."""
    pairs = nan_to_null(df.select(left.cast("double").alias("l"), right.cast("double").alias("r")))
    gap = F.col("l") - F.col("r")
    return pairs.agg(
        F.count(gap).alias("n"),
        F.avg(gap).alias("mean_residual"),
        F.stddev_samp(gap).alias("std_residual"),
        F.try_divide(
            F.pow(F.regr_sxy("l", "r"), F.lit(2)), F.regr_sxx("l", "r") * F.regr_syy("l", "r")
        ).alias("r_squared"),
    )

