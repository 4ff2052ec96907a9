"""Verdicts as files: JSON rows, or one JSON object over ordered text parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.verdicts import newest_per_id


def _quoted(col: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(col))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def verdict_entries(df: DataFrame, key: str = "id", order: str = "row_no") -> DataFrame:
    """``(key, place, entry)``: one JSON member per id, the newest row winning."""
    newest = newest_per_id(df.select(key, order, "verdict", "reason"), key, order)
    entry = F.concat(
        F.lit("  "), _quoted(F.col(key).cast("string")), F.lit(': {\n    "verdict": '),
        _quoted(F.col("verdict")), F.lit(',\n    "reason": '), _quoted(F.col("reason")),
        F.lit("\n  }"),
    )
    return newest.select(key, "place", entry.alias("entry"))


def write_verdict_rows(df: DataFrame, path: str, key: str = "id", order: str = "row_no") -> None:
    """One JSON object per line, written by all tasks."""
    newest = newest_per_id(df.select(key, order, "verdict", "reason"), key, order)
    newest.drop("place").write.json(path)


def write_verdict_object(df: DataFrame, path: str, key: str = "id", order: str = "row_no") -> None:
    """One JSON object keyed by id, as text parts.

    The parts, joined in name order, are the document. Rows are sorted by range,
    so no task and not the driver ever holds all of it.
    """
    entries = verdict_entries(df, key, order).select("place", "entry")
    last = entries.agg(F.max("place")).scalar()
    comma = F.when(F.col("place") < last, F.lit(",")).otherwise(F.lit(""))
    body = entries.select(
        F.lit(1).alias("part"), "place", F.concat("entry", comma).alias("value")
    )
    spark = df.sparkSession
    ends = spark.createDataFrame(
        [(0, 0, "{"), (2, 0, "}")], "part int, place bigint, value string"
    )
    whole = body.unionByName(ends.select("part", F.col("place"), "value"))
    whole.orderBy("part", "place").select("value").write.text(path)
