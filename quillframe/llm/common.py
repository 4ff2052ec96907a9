"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.support import scratch_path

# Rows that Arrow hands a Python worker at once; whole texts can be long.
BATCH_ROWS = 512
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SPARK_DEFAULT = "10000"


def small_batches(spark: SparkSession) -> None:
    """Bound a worker's memory by few rows per Arrow batch, where the session left the default."""
    if spark.conf.get(_BATCH_SETTING, _SPARK_DEFAULT) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.scratch = path
    return kept


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of `stored` tables. Only once all that was made of them is itself written."""
    for table in tables:
        path = getattr(table, "scratch", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def map_rows(
    df: DataFrame,
    columns: dict[str, Column],
    make: Callable[[], Callable[[dict[str, list]], dict[str, Any]]],
    schema: str,
) -> DataFrame:
    """Row-wise Python over Arrow batches of the named ``columns``.

    ``make`` runs once per task and returns the function from a batch, given as
    lists by column, to the lists (or arrays) of the result by column.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    types = {f.name: f.dataType for f in out.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fields = pa.schema([(name, to_arrow_type(kind)) for name, kind in types.items()])
        work = make()
        for batch in batches:
            given = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            got = work(given)
            yield pa.RecordBatch.from_arrays(
                [
                    got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type)
                    for f in fields
                ],
                schema=fields,
            )

    return df.select(*[c.alias(n) for n, c in columns.items()]).mapInArrow(run, out)


def utf8(name: str) -> Column:
    """A text column as bytes, a null as no bytes."""
    return F.coalesce(F.col(f"`{name}`").cast("binary"), F.lit(b""))


def text(name: str) -> Column:
    """A text column, a null as the empty text."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def text_key(text_col: str) -> Column:
    """A digest that tells texts of one id apart."""
    return F.xxhash64(utf8(text_col))
