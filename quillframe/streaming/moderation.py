"""Moderation as a resumable job: each comment file is scored once, each id has one verdict.

The same operators as the batch job run per micro-batch, and progress is kept in
the checkpoint, so a run that was cut off goes on where it stopped.

The sink is a log with one folder per micro-batch. ``current_verdicts`` reads it with the
newest verdict of an id winning. Every ``merge_every`` batches the log is merged: that
batch's folder holds the newest verdict of every id so far, and older folders go. They
go only in the next batch, when the merged one can no longer be repeated, so a run cut
off at any point loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillframe.functions import fixed_values as V
from quillframe.plans.moderation import scored_rows
from quillframe.support import remove

COMMENTS_SCHEMA = "id string, comment_text string"
# ``at``: the order column's value, if one is named; ``seen``: the micro-batch that scored the comment.
VERDICTS_SCHEMA = "id string, verdict string, reason string, at bigint, seen bigint"
MERGE_EVERY = 16


def _newest(rows: DataFrame) -> DataFrame:
    """One row per id, by a partial aggregate: the largest order value, then the latest batch."""
    rest = [c for c in rows.columns if c != "id"]
    newest = F.max_by(F.struct(*rest), F.struct("at", "seen"))
    return rows.groupBy("id").agg(newest.alias("row")).select("id", "row.*")


def _log(spark: SparkSession, sink: str, below: int | None = None) -> DataFrame:
    """The rows in the sink, of batches before ``below``."""
    try:
        rows = spark.read.schema(VERDICTS_SCHEMA + ", batch bigint").json(sink)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERDICTS_SCHEMA)
    return (rows if below is None else rows.where(F.col("batch") < below)).drop("batch")


def current_verdicts(spark: SparkSession, sink: str) -> DataFrame:
    """``(id, verdict, reason)``: the newest verdict of every id that the stream has scored."""
    return _newest(_log(spark, sink)).select("id", "verdict", "reason")


def moderate_new_files(
    spark: SparkSession,
    source: str,
    sink: str,
    make_client: Callable[[], Callable[[str], str]],
    progress: str,
    max_attempts: int = V.MAX_ATTEMPTS,
    order: str | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Score the CSV comment files not seen yet and write verdict rows as JSON.

    ``progress`` is the checkpoint folder to resume from. Each micro-batch has a
    folder of its own that a repeated batch replaces, so a retry adds nothing
    twice. With ``order``, a third column of whole numbers, the comment with the largest
    value counts, also where it arrives before others (a missing value is the smallest);
    otherwise the one that arrived last.
    """
    schema = COMMENTS_SCHEMA + (f", `{order}` bigint" if order else "")
    comments = (
        spark.readStream.schema(schema)
        .options(header=True, multiLine=True, escape='"')
        .csv(source)
    )
    root = sink.rstrip("/")

    def score(batch: DataFrame, number: int) -> None:
        if number % merge_every == 0:  # the batch before this one was merged, and is done
            for old in range(max(0, number - 1 - merge_every), number - 1):
                remove(spark, f"{root}/batch={old}")
        if order:
            least = F.lit(-(2**63)).cast("bigint")
            batch = batch.withColumn(order, F.coalesce(F.col(f"`{order}`"), least))
        rows = scored_rows(batch, make_client, max_attempts, order)
        at = F.max("row_no") if order else F.lit(None).cast("bigint")
        newest = F.max_by(F.struct("verdict", "reason"), "row_no")
        found = rows.groupBy("id").agg(newest.alias("row"), at.alias("at"))
        found = found.select("id", "row.*", "at", F.lit(number).cast("bigint").alias("seen"))
        if (number + 1) % merge_every == 0:
            found = _newest(found.unionByName(_log(spark, root, below=number)))
        found.write.mode("overwrite").json(f"{root}/batch={number}")

    return (
        comments.writeStream.foreachBatch(score)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
