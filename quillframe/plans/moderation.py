"""Scoring a table of comments: by a trained classifier or by a caller's client."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V
from quillframe.functions.text import chat_messages, moderation_prompt
from quillframe.operators.groups import with_class_weight
from quillframe.operators.sampling import first_two_columns
from quillframe.operators.verdicts import first_valid_attempt, newest_per_id

_WORDS = 1 << 16


def _read_order(comments: DataFrame) -> Column:
    """A sortable number or text per row: by file, then place in the file; else as partitions lie.

    Splits of files are dealt to tasks by size, so the number of a task says
    nothing about the order of files.
    """
    here = F.monotonically_increasing_id()
    try:
        comments.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return here
    parts = [F.lpad(n.cast("string"), 20, "0") for n in (F.col("_metadata.file_block_start"), here)]
    return F.concat_ws("\t", F.col("_metadata.file_path"), *parts)


def prompts(comments: DataFrame, order: str | None = None) -> DataFrame:
    """``(id, row_no, prompt, messages)`` from the first two columns, by position.

    ``row_no`` is the column ``order`` if named, else the order of the rows in
    their files.
    """
    row_no = F.col(f"`{order}`") if order else _read_order(comments)
    key, comment = first_two_columns(comments).columns
    asked = comments.select(
        F.col(f"`{key}`").alias("id"),
        row_no.alias("row_no"),
        moderation_prompt(F.col(f"`{comment}`")).alias("prompt"),
    )
    return asked.withColumn("messages", chat_messages(F.lit(V.MODERATION_SYSTEM), F.col("prompt")))


def train_toxicity(df: DataFrame, text: str, label: str) -> PipelineModel:
    """Bag-of-words logistic regression with balanced classes."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="__words", outputCol="__counts", numFeatures=_WORDS),
        IDF(inputCol="__counts", outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="__weight", maxIter=20, regParam=0.01),
    ]
    known = df.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    return Pipeline(stages=stages).fit(with_class_weight(known, label, "__weight"))


def score_text(
    df: DataFrame, model: PipelineModel, text: str, low: float = 0.35, high: float = 0.65
) -> DataFrame:
    """Add ``score``, ``verdict`` and ``reason``; between the bounds it is uncertain.

    A missing text cannot be judged and is uncertain too.
    """
    filled = df.withColumn("__given", F.col(text)).withColumn(
        text, F.coalesce(text, F.lit(""))
    )
    p = vector_to_array("probability")[1]
    scored = model.transform(filled).withColumn("score", F.when(F.col("__given").isNotNull(), p))
    verdict = (
        F.when(F.col("score") >= high, "toxic")
        .when(F.col("score") <= low, "non-toxic")
        .otherwise("uncertain")
    )
    return scored.select(
        *[F.col("__given").alias(c) if c == text else F.col(c) for c in df.columns],
        "score",
        verdict.alias("verdict"),
        F.concat(F.lit("p = "), F.format_string("%.3f", "score")).alias("reason"),
    )


def _acceptable(raw: str | None) -> bool:
    """Whether asking again is pointless; the verdict itself is read JVM-side."""
    try:
        verdict = json.loads(raw or "").get("verdict")
    except (ValueError, AttributeError):
        return False
    return isinstance(verdict, str) and verdict.strip().lower() in V.VERDICTS


def ask(
    asked: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    max_attempts: int = V.MAX_ATTEMPTS,
) -> DataFrame:
    """``(id, row_no, attempt, raw, error)`` from a client called for each prompt.

    One client per task. Every try is a row, up to the first acceptable answer.
    """

    names = ["id", "row_no", "attempt", "raw", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            tries = []
            for key, row_no, prompt in batch.itertuples(index=False):
                for attempt in range(max_attempts):
                    raw = error = None
                    try:
                        if prompt is None:
                            raise TypeError("comment is missing")
                        raw = client(prompt)
                    except Exception as e:  # whatever the client raises is an attempt
                        error = f"{type(e).__name__}: {e}"
                    tries.append((key, row_no, attempt, raw, error))
                    if prompt is None or _acceptable(raw):
                        break
            yield pd.DataFrame(tries, columns=names)

    key_type, order_type = (asked.schema[c].dataType.simpleString() for c in ("id", "row_no"))
    return asked.select("id", "row_no", "prompt").mapInPandas(
        run, f"id {key_type}, row_no {order_type}, attempt int, raw string, error string"
    )


def scored_rows(
    comments: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    max_attempts: int = V.MAX_ATTEMPTS,
    order: str | None = None,
) -> DataFrame:
    """``(id, row_no, verdict, reason)``: every row of a comments table scored."""
    tries = ask(prompts(comments, order), make_client, max_attempts)
    return first_valid_attempt(tries, "id", "row_no", max_attempts=max_attempts)


def moderate(
    comments: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    max_attempts: int = V.MAX_ATTEMPTS,
    order: str | None = None,
) -> DataFrame:
    """``(id, verdict, reason)`` for a comments table, whole and in parallel.

    Of rows with the same id the last one counts: by the column ``order``, else by
    file and place in the file.
    """
    verdicts = scored_rows(comments, make_client, max_attempts, order)
    return newest_per_id(verdicts, "id", "row_no").drop("place")
