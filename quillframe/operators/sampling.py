"""Head and block of rows in a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quillframe.functions import fixed_values as V


def first_two_columns(df: DataFrame) -> DataFrame:
    """Id and text by position, whatever their names."""
    return df.select(df.columns[0], df.columns[1])


def head_rows(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_block(
    df: DataFrame, order: Sequence[str], k: int, size: int = V.BLOCK_ROWS, strict: bool = True
) -> DataFrame:
    """Rows ``k * size`` up to the next block, ``k`` from 0 to 100.

    Offset with limit is a bounded top-k: a task keeps at most 10,100 rows, and
    the table is not sorted as a whole. A table too short for the block raises,
    unless ``strict`` is off.
    """
    if not 0 <= k <= 100:
        raise ValueError("k must lie between 0 and 100")
    block = df.orderBy(*order).offset(k * size).limit(size)
    if strict and block.count() < size:
        raise IndexError(f"the table has fewer than {(k + 1) * size} rows")
    return block
