"""Baseline models and their scores, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    Bucketizer,
    Imputer,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.operators.groups import with_class_weight
from quillframe.support import even_shares

# Ranges of scores ranked apart, and rows looked at to place their borders.
_SCORE_SLICES = 4_096
_CUT_ROWS = 2_000_000


def _prepared(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """One-hot categories and standardised numbers in one sparse vector.

    No row is left out: a missing number becomes the mean of the column, and a
    second column says that it was missing.
    """
    given = [f"__{c}_number" for c in numeric]
    missing = [f"__{c}_missing" for c in numeric]
    filled = [f"__{c}_filled" for c in numeric]
    added = ", ".join(
        f"CAST(`{c}` AS DOUBLE) AS `{g}`, "
        f"CAST(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)) AS DOUBLE) AS `{m}`"
        for c, g, m in zip(numeric, given, missing, strict=True)
    )
    stages = [
        SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__"),
        Imputer(inputCols=given, outputCols=filled),
        VectorAssembler(inputCols=[*filled, *missing], outputCol="__numbers"),
        StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True),
    ]
    parts = ["__scaled"]
    if categorical:
        indexed = [f"__{c}_index" for c in categorical]
        coded = [f"__{c}_code" for c in categorical]
        stages.append(
            StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep")
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded))
        parts += coded
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def fit_logistic(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    weighted: bool = True,
) -> PipelineModel:
    """Logistic regression, by default with balanced class weights."""
    rows = with_class_weight(df, target, "__weight") if weighted else df
    model = LogisticRegression(
        labelCol=target, maxIter=30, **({"weightCol": "__weight"} if weighted else {})
    )
    return Pipeline(stages=[*_prepared(numeric, categorical), model]).fit(rows)


def fit_gbt(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    rounds: int = 10,
    seed: int = 7,
) -> PipelineModel:
    """Gradient-boosted trees."""
    model = GBTClassifier(labelCol=target, maxIter=rounds, maxDepth=4, seed=seed)
    return Pipeline(stages=[*_prepared(numeric, categorical), model]).fit(df)


def with_score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Rows with the probability of class 1; helper columns removed."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def f1_auc(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row ``(n, f1, auc)`` for 0/1 labels and scores, both exact.

    AUC counts, for every score, the negatives below it, ties at one half.
    Counts per distinct score are combined before the shuffle and cumulated per
    range of scores on top of range totals, so no task orders all scores.
    """
    rows = df.select(
        F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("s")
    ).where(F.col("y").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    said = F.col("s") >= threshold
    positive = F.col("y") == 1
    totals = rows.agg(
        F.count("*").alias("n"),
        F.count_if(positive).alias("p"),
        F.count_if(said & positive).alias("tp"),
        F.count_if(said & ~positive).alias("fp"),
    ).first()
    n, p, tp, fp = (totals[c] for c in ("n", "p", "tp", "fp"))
    # Where the ranges are cut decides only how even they are, so some rows do.
    some = rows.sample(fraction=_CUT_ROWS / n, seed=1) if n > _CUT_ROWS else rows
    cuts = some.agg(F.percentile_approx("s", even_shares(_SCORE_SLICES, False))).first()[0]
    f1 = 2 * tp / (p + tp + fp) if p + tp + fp else None

    splits = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    counts = rows.groupBy("s").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    sliced = counts
    if len(splits) >= 3:
        sliced = Bucketizer(splits=splits, inputCol="s", outputCol="slice").transform(counts)
    else:
        sliced = counts.withColumn("slice", F.lit(0.0))
    in_slice = W.partitionBy("slice").orderBy("s").rowsBetween(W.unboundedPreceding, 0)
    # One row per range is left here, a few thousand at most.
    per_slice = (
        sliced.withColumn("upto", F.sum("neg").over(in_slice))
        .groupBy("slice")
        .agg(
            F.sum("neg").alias("neg"),
            F.sum("pos").alias("pos"),
            F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("won"),
        )
    )
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0))
    wins = per_slice.withColumn("won", F.col("won") + F.col("pos") * below)
    return wins.agg(
        F.lit(n).cast("bigint").alias("n"),
        F.lit(f1).cast("double").alias("f1"),
        F.try_divide(F.sum("won").cast("double"), F.lit(float(p) * (n - p))).alias("auc"),
    )
