"""Verdict rows: validation, first valid attempt, newest row per id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V
from quillframe.functions.json_text import is_json, validate_verdict


def validate_verdicts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``valid``, ``verdict`` and ``reason``; both texts are NULL when invalid."""
    checked = df.withColumn("__v", validate_verdict(F.col(raw)))
    return checked.select(
        *df.columns,
        F.col("__v").isNotNull().alias("valid"),
        F.col("__v.verdict").alias("verdict"),
        F.col("__v.reason").alias("reason"),
    )


def first_valid_attempt(
    attempts: DataFrame, *keys: str, max_attempts: int = V.MAX_ATTEMPTS
) -> DataFrame:
    """``(*keys, verdict, reason)`` from rows ``(*keys, attempt, raw, error)``.

    The earliest valid answer wins. Without one the verdict is ``uncertain`` and
    the reason carries the last error. Both are partial aggregates, so nothing
    is gathered per key.
    """
    keys = keys or ("id",)
    failed = F.coalesce(
        F.col("error"),
        F.when(is_json(F.col("raw")), F.concat(F.lit(V.SCHEMA_MISMATCH), F.col("raw"))),
        F.concat(F.lit("JSONDecodeError: "), F.coalesce("raw", F.lit(""))),
    )
    tried = attempts.where(F.col("attempt") < max_attempts).select(
        *keys, "attempt", failed.alias("failed"),
        F.when(F.col("error").isNull(), validate_verdict(F.col("raw"))).alias("answer"),
    )
    best = tried.groupBy(*keys).agg(
        F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("attempt"))).alias("answer"),
        F.max_by("failed", "attempt").alias("failed"),
    )
    fallback = F.concat(
        F.lit(V.FALLBACK_REASON.format(attempts=max_attempts)), F.col("failed")
    )
    return best.select(
        *keys,
        F.coalesce(F.col("answer.verdict"), F.lit("uncertain")).alias("verdict"),
        F.coalesce(F.col("answer.reason"), fallback).alias("reason"),
    )


def newest_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per id: the last row's values, at the place of the id's first row."""
    rest = [c for c in df.columns if c not in (key, order)]
    newest = df.groupBy(key).agg(
        F.min(order).alias("place"), F.max_by(F.struct(*rest), order).alias("row")
    )
    return newest.select(key, "place", "row.*")
