"""A five-section report of numbers about a table and a 0/1 target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import fixed_values as V
from quillframe.operators.charts import iqr_bounds, outlier_counts
from quillframe.operators.groups import prevalence
from quillframe.operators.quantiles import STATE_VALUES
from quillframe.support import as_doubles, present

# Features named in the advice on a model.
TOP_FEATURES = 5
# Findings that a report should have.
LEAST_FINDINGS = 5


def _num(value: Column, digits: int = 4) -> Column:
    return F.coalesce(value.try_cast(f"decimal(38,{digits})").cast("string"), F.lit("?"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _class_correlation(x: Column, y: Column) -> Column:
    """Pearson r of a number with a 0/1 target, from class means and sizes."""
    one, zero = F.when(y == 1, x), F.when(y == 0, x)
    n1, n0 = F.count(one), F.count(zero)
    spread = F.stddev_pop(F.when(y.isin(0, 1), x))
    share = F.sqrt(n1.cast("double") * n0) / (n1 + n0)
    return F.when(n1 + n0 > 0, F.try_divide((F.avg(one) - F.avg(zero)) * share, spread))


def _figures(
    df: DataFrame, target: str, columns: list[str], bounds: dict
) -> DataFrame:
    """All figures of the report as one row: class sizes, missing cells and a struct per column."""
    y = F.col(target)
    gaps = {f"__gap{i}": present(f.name, f.dataType).isNull() for i, f in enumerate(df.schema)}
    data = as_doubles(df.withColumns(gaps), [*columns, target], keep=list(gaps))

    def of_column(c: str) -> Column:
        below, above = outlier_counts(c, bounds[c])
        lo, hi = bounds[c] or (None, None)
        return F.struct(
            F.lit(c).alias("name"),
            F.avg(c).alias("mean"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.avg(F.when(y == 1, F.col(c))).alias("mean1"),
            F.avg(F.when(y == 0, F.col(c))).alias("mean0"),
            _class_correlation(F.col(c), y).alias("r"),
            F.lit(lo).cast("double").alias("lo"),
            F.lit(hi).cast("double").alias("hi"),
            (below + above).alias("outside"),
        ).alias(c)

    one = data.agg(
        F.count("*").alias("rows"),
        F.count_if(y == 1).alias("n1"),
        F.count_if(y == 0).alias("n0"),
        F.array_sort(
            F.array(
                *[
                    F.struct((-F.count_if(g)).alias("order"), F.lit(c).alias("name"))
                    for g, c in zip(gaps, df.columns, strict=True)
                ]
            )
        ).alias("missing"),
        *[of_column(c) for c in columns],
    )
    by_r = F.array_sort(
        F.array(
            *[
                F.struct(
                    F.coalesce(-F.round(F.abs(F.col(c)["r"]), 6), F.lit(0.0)).alias("order"),
                    F.col(c)["name"].alias("name"),
                    F.col(c).alias("s"),
                )
                for c in columns
            ]
        )
    )
    by_outside = F.array_sort(
        F.array(
            *[
                F.struct(
                    (-F.col(c)["outside"]).alias("order"),
                    F.col(c)["name"].alias("name"),
                    F.col(c).alias("s"),
                )
                for c in columns
            ]
        )
    )
    return one.withColumns({"by_r": by_r, "by_outside": by_outside})


def _bullet(number: int, n: Column, text: Column, value: Column) -> list[Column]:
    return [
        F.lit(number).alias("section_no"),
        F.lit(V.REPORT_SECTIONS[number - 1]).alias("section"),
        n.cast("int").alias("n"),
        text.alias("text"),
        value.cast("double").alias("value"),
    ]


def _subgroup_findings(df: DataFrame, target: str, groups: list[str], after: int) -> DataFrame:
    """A bullet per category: its values with the lowest and the highest share of class 1.

    Equal shares: the least value is the lowest, the greatest the highest.
    """
    rates = prevalence(df, target, groups).where(F.col("n") > 0)
    rate = F.struct("prevalence", F.coalesce("value", F.lit("?")).alias("value"))
    ends = rates.groupBy("dimension").agg(F.min(rate).alias("low"), F.max(rate).alias("high"))
    low, high = F.col("low"), F.col("high")
    points = 100 * (high["prevalence"] - low["prevalence"])
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("dimension"))
    text = _text(
        F.col("dimension"), ": доля класса 1 от ", _num(low["prevalence"]), " (", low["value"], ") до ",
        _num(high["prevalence"]), " (", high["value"], "), разница ", _num(points, 2), " п. п.",
    )
    return ends.select(*_bullet(3, place + after, text, points))


def auto_report(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    groups: Sequence[str] = (),
    state_values: int = STATE_VALUES,
) -> DataFrame:
    """``(section_no, section, n, text, value)``: one row per bullet.

    Outlier bounds need the quartiles first; every other figure comes from one
    aggregate, and the bullets are cut from its single row. Findings are the correlation of
    each numeric column, the missing cells (of single columns too, where five findings are not
    reached otherwise) and, from a second aggregate, the subgroup shares of the categories ``groups``.
    A category without a labelled row has no bullet.
    """
    columns, groups = list(columns), list(groups)
    bounds = iqr_bounds(df, columns, state_values)
    one = _figures(df, target, columns, bounds)
    rows, n1, n0 = F.col("rows"), F.col("n1"), F.col("n0")
    labelled = n1 + n0
    top, weakest = F.col("by_r")[0]["s"], F.col("by_r")[len(columns) - 1]["s"]
    worst = F.col("by_outside")[0]["s"]

    def weight(n: Column) -> Column:
        return F.try_divide(labelled.cast("double"), 2 * n)

    summary = [
        (_text("Строк: ", rows.cast("string"), f", столбцов: {len(df.columns)}"), rows),
        (
            _text("Доля класса 1: ", _num(F.try_divide(n1.cast("double"), labelled)),
                  " (", n1.cast("string"), " из ", labelled.cast("string"), ")"),
            F.try_divide(n1.cast("double"), labelled),
        ),
        (_text("Сильнее всего с целевой связан ", top["name"], ": r = ", _num(top["r"])), top["r"]),
    ]
    figures = [
        (_text("Размер классов: ", n0.cast("string"), " и ", n1.cast("string")), n1)
    ] + [
        (
            _text(f"{c}: среднее ", _num(F.col(c)["mean"]), ", минимум ", _num(F.col(c)["min"]),
                  ", максимум ", _num(F.col(c)["max"])),
            F.col(c)["mean"],
        )
        for c in columns
    ]

    def finding(x: Column) -> tuple[Column, Column]:
        change = 100 * F.try_divide(x["mean1"] - x["mean0"], x["mean0"])
        return (
            _text(x["name"], ": r = ", _num(x["r"]), " с целевой; среднее ", _num(x["mean1"]),
                  " в классе 1 и ", _num(x["mean0"]), " в классе 0 (", _num(change, 2),
                  " % от класса 0)"),
            x["r"],
        )

    def gap(i: int) -> tuple[Column, Column]:
        x = F.col("missing")[i]
        share = F.try_divide(-100.0 * x["order"], rows)
        return _text(x["name"], ": пропусков ", (-x["order"]).cast("string"), " (", _num(share, 2), " %)"), -x["order"]

    gaps = F.aggregate("missing", F.lit(0).cast("bigint"), lambda n, x: n - x["order"])
    most = F.col("missing")[0]
    findings = [finding(F.col("by_r")[i]["s"]) for i in range(len(columns))]
    findings.append(
        (
            _text("Пропусков: ", gaps.cast("string"), ", больше всего в ", most["name"], ": ",
                  (-most["order"]).cast("string")),
            gaps,
        )
    )
    short = LEAST_FINDINGS - len(findings) - len(groups)
    findings += [gap(i) for i in range(min(max(short, 0), len(df.columns)))]

    def anomaly(x: Column) -> tuple[Column, Column]:
        found = _text(
            x["name"], ": границы ", _num(x["lo"]), " и ", _num(x["hi"]), ", за ними ",
            x["outside"].cast("string"),
        )
        none = _text(x["name"], ": " + V.NOTHING_FOUND)
        return F.when(x["outside"] > 0, found).otherwise(none), x["outside"]

    anomalies = [anomaly(F.col(c)) for c in columns]
    named = F.array_join(
        F.transform(
            F.slice("by_r", 1, TOP_FEATURES),
            lambda e: _text(e["name"], " r = ", _num(e["s"]["r"])),
        ),
        ", ",
    )
    advice = [
        (_text("Обучить логистическую регрессию по признакам: ", named), top["r"]),
        (
            _text("Взвесить классы: ", _num(weight(n1)), " для класса 1 и ", _num(weight(n0)),
                  " для класса 0"),
            weight(n1),
        ),
        (
            _text("Проверить ", worst["name"], ": за границами ", worst["outside"].cast("string")),
            worst["outside"],
        ),
        (_text("Исключить ", weakest["name"], ": r = ", _num(weakest["r"])), weakest["r"]),
    ]
    lists = [summary, figures, findings, anomalies, advice]
    bullets = [
        F.struct(*_bullet(number, F.lit(n), text, value))
        for number, items in enumerate(lists, 1)
        for n, (text, value) in enumerate(items, 1)
    ]
    report = one.select(F.inline(F.array(*bullets)))
    if groups:
        report = report.union(_subgroup_findings(df, target, groups, len(findings)))
    return report


def report_text(report: DataFrame) -> DataFrame:
    """The report as one text: titles, then ``-`` bullets. It has a few dozen rows."""
    sections = report.groupBy("section_no", "section").agg(
        F.array_sort(F.collect_list(F.struct("n", "text"))).alias("items")
    )
    block = F.concat(
        "section", F.lit("\n"),
        F.array_join(F.transform("items", lambda b: F.concat(F.lit("- "), b["text"])), "\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("section_no", block.alias("block"))))
    return sections.agg(
        F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("text")
    )
