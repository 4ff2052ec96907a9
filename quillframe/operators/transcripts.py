"""Chat transcripts and run traces in long form: one row per message or event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V
from quillframe.functions.text import strip_text

# Rows of one conversation that a single window task may have to order.
SLICE_ROWS = 200_000
# Messages packed into one array row.
PACK_MESSAGES = 1_000


def running_count(
    df: DataFrame,
    key: str,
    order: str,
    measure: Column,
    name: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``name``: the sum of ``measure`` within ``key`` up to and with this row.

    ``order`` is a whole number, unique within its key, so a stretch of
    ``slice_rows`` consecutive numbers holds at most that many rows. If the whole
    range fits in one stretch a plain window does. Otherwise windows run per
    (key, stretch) on top of per-stretch totals, and one conversation holding a
    third of the table is still spread over many tasks.
    """
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    rows = df.withColumn("__measure", measure.cast("bigint"))
    if ends["lo"] is None or ends["hi"] - ends["lo"] < slice_rows:
        upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum("__measure").over(upto)).drop("__measure")

    rows = rows.withColumn("__slice", F.floor((F.col(order) - ends["lo"]) / slice_rows))
    earlier = W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(key, "__slice")
        .agg(F.sum("__measure").alias("__total"))
        .select(
            key, "__slice",
            F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"),
        )
    )
    upto = W.partitionBy(key, "__slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.join(offsets, [key, "__slice"])
        .withColumn(name, F.col("__offset") + F.sum("__measure").over(upto))
        .drop("__measure", "__slice", "__offset")
    )


def assemble_transcript(
    messages: DataFrame, key: str = "conv_id", order: str = "turn", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Messages with their ``position`` from 1 in the conversation."""
    return running_count(messages, key, order, F.lit(1), "position", slice_rows)


def pack_transcripts(
    messages: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    pack: int = PACK_MESSAGES,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(key, part, messages)`` with the messages as an ordered array.

    A conversation of up to ``pack`` messages is one row. A longer one continues
    in further parts, so no array grows without bound and nothing is left out.
    """
    placed = assemble_transcript(messages, key, order, slice_rows)
    message = F.struct("position", "role", F.col("text").alias("content"))
    return (
        placed.groupBy(key, F.ceil(F.col("position") / pack).alias("part"))
        .agg(F.array_sort(F.collect_list(message)).alias("messages"))
    )


def cap_turns(
    messages: DataFrame, limit: int = V.MAX_TOOL_ROUNDS, key: str = "conv_id", order: str = "turn"
) -> DataFrame:
    """The first ``limit`` rows per conversation, cut down before the shuffle."""
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    return messages.withColumn("round", place).where(F.col("round") <= limit)


def number_steps(
    trace: DataFrame, key: str = "conv_id", order: str = "turn", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add ``step``: the running number of tool calls; other events have none."""
    is_call = F.col("type").isin("tool_call", "unknown_tool")
    counted = running_count(trace, key, order, F.when(is_call, 1).otherwise(0), "step", slice_rows)
    return counted.withColumn("step", F.when(is_call, F.col("step")))


def _report_text(order: str) -> Column:
    """The newest final text of a run, as an aggregate; NULL when there is none."""
    final = F.col("type").isin("final", "forced_final")
    return F.max_by(
        F.when(final, F.struct(strip_text(F.coalesce("text", F.lit(""))).alias("t"))),
        F.when(final, F.col(order)),
    )["t"]


def run_outcome(trace: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """``(key, outcome)`` of every run.

    ``final`` came unasked; a forced final follows a model error, an empty final
    message or the iteration cap; a run without any final text is ``no_report``.
    """
    kind = F.col("type")
    seen = trace.groupBy(key).agg(
        _report_text(order).alias("report"),
        F.count_if(kind == "forced_final").alias("forced"),
        F.count_if(kind == "model_error").alias("errors"),
        F.count_if(kind == "final").alias("finals"),
    )
    return seen.select(
        key,
        F.when(F.coalesce("report", F.lit("")) == "", "no_report")
        .when(F.col("forced") == 0, "final")
        .when(F.col("errors") > 0, "forced_after_error")
        .when(F.col("finals") > 0, "forced_after_empty")
        .otherwise("forced_after_cap")
        .alias("outcome"),
    )


def final_answer(
    messages: DataFrame, key: str = "conv_id", order: str = "turn", tool: str | None = None
) -> DataFrame:
    """``(key, answer)``: the last assistant text without a tool call, stripped."""
    answers = F.col("role") == "assistant"
    if tool:
        answers = answers & F.col(tool).isNull()
    return (
        messages.where(answers)
        .groupBy(key)
        .agg(strip_text(F.max_by("text", order)).alias("answer"))
    )


def run_summary(trace: DataFrame, key: str = "conv_id", shapes: DataFrame | None = None) -> DataFrame:
    """``(key, events, tool_calls, charts, suspicious)`` per run.

    ``shapes`` (key, rows, cols) adds the size of the table that the run analysed, one row a run.
    """
    summary = trace.groupBy(key).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("type") == "tool_call").alias("tool_calls"),
        F.least(F.sum("charts"), F.lit(V.MAX_CHARTS)).cast("bigint").alias("charts"),
        F.bool_or("suspicious").alias("suspicious"),
    )
    return summary if shapes is None else summary.join(shapes, key, "left")
