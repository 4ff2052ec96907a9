"""Cluster-safe helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of at most this many rows may be brought to the driver and broadcast.
SMALL_SIDE_ROWS = 20_000
# A larger side is repeated so many times for a join, that rows of one key are spread.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a session on one machine may leave it unnamed; anywhere else a folder of
    our own would lie on one machine's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "local")
    if not re.match(r"local(\[[^\]]*\])?$", master or ""):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return _own_dir()


@cache
def _own_dir() -> str:
    """For a session on one machine that names no folder, as in tests."""
    return tempfile.mkdtemp(prefix="quillframe-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read files, so a lost executor costs nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def small_or_cut(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Compute ``df`` once, for joining it to a big side.

    Up to ``max_rows`` rows it becomes a literal table with a broadcast hint. A
    larger one is checkpointed and carries no hint, so Spark chooses a shuffle
    join, with adaptive splitting of skewed keys.
    """
    small = _small(df, max_rows)
    return cut_lineage(df) if small is None else small


def _small(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame | None:
    """``df`` as a literal table to broadcast, if it is small."""
    head = df.take(max_rows + 1)
    if len(head) <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))
    return None


def join_side(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``rows`` with a table of few rows a key, on ``on``, null keys being equal.

    A side of at most ``SMALL_SIDE_ROWS`` rows is broadcast. A larger one is repeated
    under ``SALTS`` numbers, and a row looks under the one of its partition, so that a key which
    many rows share is not one task's.
    """
    keys = {c: f"__{c}" for c in on}
    side = side.withColumnsRenamed(keys)
    small = _small(side)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    if small is None:
        small = cut_lineage(side).withColumn("__side", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        same.append(F.col("__salt") == F.col("__side"))
    return rows.join(small, reduce(lambda x, y: x & y, same)).drop("__salt", "__side", *keys.values())


def spread(df: DataFrame) -> DataFrame:
    """Give costly row-wise work at least one partition per core.

    For a table stored in fewer splits than there are cores, such as one file
    with one row group. A table with enough splits is returned as it is, without
    a shuffle. For stored tables only: asking a join for its partitions runs it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def present(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into NULL."""
    col = F.col(f"`{name}`")
    return F.when(~F.isnan(col), col) if is_float(dtype) else col


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    wanted = df.columns if columns is None else columns
    return df.select(*[present(c, df.schema[c].dataType).alias(c) for c in wanted])


def as_doubles(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``keep`` as it is and ``columns`` as doubles, NaN removed."""
    return df.select(
        *(keep or []),
        *[present(c, df.schema[c].dataType).cast("double").alias(c) for c in columns],
    )


def even_shares(steps: int, ends: bool = True) -> Column:
    """The array 0, 1/steps, ..., 1 as one constant; without ``ends`` the inner shares."""
    numbers = range(steps + 1) if ends else range(1, steps)
    return F.expr("array(" + ", ".join(f"{i / steps!r}D" for i in numbers) + ")")


def rows_from_one(row: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row frame into one row per struct, without another scan."""
    return row.select(F.inline(F.array(*structs)))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``df`` with a column ``name`` counting its rows from 0 in the given order.

    Rows are sorted by ranges, one range a task, and written to the shared folder; the
    driver sees only one count a range. Rows equal in all of ``order`` are numbered in any order.
    """
    spark = df.sparkSession
    inner = F.monotonically_increasing_id().alias("_place")
    path = scratch_path(spark, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", inner).write.parquet(path)
    placed = spark.read.parquet(path)
    part = F.shiftright("_place", 33)
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append(F.struct(F.lit(r["part"]).cast("long").alias("part"), F.lit(before).cast("long").alias("start")))
        before += r["count"]
    within = F.col("_place").bitwiseAND((1 << 33) - 1)
    if not starts:
        return placed.select(*df.columns, F.lit(0).cast("long").alias(name)).limit(0)
    table = F.map_from_entries(F.array(*starts))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (within + table[part]).alias(name))
