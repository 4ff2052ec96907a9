"""CSV tables: header, missing tokens, inferred types, over-long rows refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import fixed_values as V
from quillframe.sources.csv_records import read_cells

_OVERLONG = "CSV row has more fields than the header"
# Checked before casting, because a failing cast of a text costs an exception.
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)\s*$"


def null_if_missing(col: Column) -> Column:
    return F.when(~col.isin(*V.MISSING_TOKENS), col)


def typed(text: Column, kind: T.DataType) -> Column:
    """A text as the type; a whole number may be written with a fraction part, as in "1.0"."""
    if isinstance(kind, T.IntegralType):
        text = F.coalesce(text.try_cast("bigint"), text.cast("double").cast("bigint"))
    return text.cast(kind)


def read_csv_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text, missing tokens as NULL.

    A row with more fields than the header stops the job; a shorter one is
    filled with NULL. A quoted cell may span lines; files of any size are read in
    ranges by many tasks all the same.
    """
    rows = read_cells(spark, path, sep, _OVERLONG)
    return rows.select(*[null_if_missing(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to long, double or boolean where every value allows it."""
    def checks(c: str) -> Column:
        text = F.col(f"`{c}`")
        return F.struct(
            F.count(text).alias("n"),
            F.count(F.when(text.rlike(_WHOLE), text.try_cast("bigint"))).alias("whole"),
            F.count_if(text.rlike(_NUMBER)).alias("number"),
            F.count_if(text.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias("truth"),
        ).alias(c)

    seen = df.agg(*[checks(c) for c in df.columns]).first()

    def kind(c: str) -> str:
        n = seen[c]["n"]
        if n == 0:
            return "double"
        for name, dtype in (("whole", "bigint"), ("number", "double"), ("truth", "boolean")):
            if seen[c][name] == n:
                return dtype
        return "string"

    return df.select(*[F.col(f"`{c}`").cast(kind(c)).alias(c) for c in df.columns])


def read_csv_table(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    sep: str = ",",
) -> DataFrame:
    """A CSV table with the given types, or with types inferred from all its rows."""
    text = read_csv_text(spark, path, sep)
    if schema is None:
        return infer_types(text)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    return text.select(*[typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
