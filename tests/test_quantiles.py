import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe import support
from quillframe.operators import quantiles
from quillframe.operators.charts import box_by_group, histogram, iqr_outliers
from quillframe.operators.correlation import corr_pairs, scatter_grid, scatter_points, scatter_sample
from quillframe.operators.profile import describe_numeric
from quillframe.operators.quantiles import exact_quantiles
from quillframe.support import join_side

PROBS = [0.0, 0.01, 0.75]


def _frame(spark, arrays):
    names = list(arrays)
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*arrays.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def _data(seed, n=4000):
    rng = np.random.default_rng(seed)
    return {
        "even": rng.uniform(-5, 5, n),
        "heavy": rng.standard_cauchy(n) * 1e6,
        "tied": np.where(rng.uniform(size=n) < 0.4, 7.0, rng.normal(7, 2, n)),
    }


@pytest.mark.parametrize("state_values", [30, 10**6])
def test_whole_table_equals_numpy(spark, state_values):
    data = {k: v for k, v in _data(1).items() if k != "even"}
    df = _frame(spark, data).repartition(5).cache()
    found = exact_quantiles(df, list(data), PROBS, state_values=state_values).collect()
    assert {r["column_name"] for r in found} == set(data)
    for row in found:
        want = np.quantile(data[row["column_name"]], PROBS)
        assert np.allclose(row["q"], want, rtol=1e-12, atol=1e-12)
        assert row["n"] == 4000


@pytest.mark.parametrize("state_values", [20, 10**6])
def test_groups_with_one_hot_group(spark, state_values):
    data = {k: v for k, v in _data(2).items() if k != "even"}
    rng = np.random.default_rng(3)
    group = np.where(rng.uniform(size=4000) < 0.4, 0, rng.integers(1, 9, 4000))
    df = _frame(spark, {"g": group, **data}).repartition(4).cache()
    found = exact_quantiles(df, list(data), PROBS, ["g"], state_values).collect()
    assert len(found) == 9 * 2
    for row in found:
        values = data[row["column_name"]][group == row["g"]]
        assert row["n"] == len(values)
        assert np.allclose(row["q"], np.quantile(values, PROBS), rtol=1e-12, atol=1e-12)


def test_many_groups_take_the_rounds_of_few(spark, monkeypatch):
    """Scans of the rows by radix selection; with sides joined both ways."""
    rounds = {}
    for groups, small in ((10, 20_000), (10_000, 20_000), (3000, 0)):
        monkeypatch.setattr(support._small, "__defaults__", (small,))
        rng = np.random.default_rng(groups)
        data = {"g": rng.integers(0, groups, 30_000), "v": np.concatenate([rng.normal(size=20_000), np.full(10_000, -0.0)])}
        passes = []
        monkeypatch.setattr(quantiles, "join_side", lambda *a: (passes.append(1), join_side(*a))[1])
        found = exact_quantiles(_frame(spark, data), ["v"], [0.5], ["g"], 10, {"v": 10**9}).collect()
        rounds[groups] = len(passes)
        want = pd.DataFrame(data).groupby("g")["v"].median()
        assert {r["g"]: r["q"][0] for r in found} == pytest.approx(want.to_dict(), abs=1e-12)
    assert rounds[10] == rounds[10_000] == rounds[3000] <= 8


def test_order_of_numbers_is_the_order_of_doubles(spark):
    values = [-np.inf, -1e300, -2.5, -1e-310, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf]
    df = _frame(spark, {"v": values}).repartition(3)
    rows = df.select("v", quantiles._ordered(F.col("v")).alias("k")).withColumn("back", quantiles._value(F.col("k"))).collect()
    assert [r["v"] for r in sorted(rows, key=lambda r: r["k"])] == values
    assert all(r["v"] == r["back"] for r in rows)


def test_missing_values_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    for state in (1, 100):
        row = exact_quantiles(df, ["v"], [0.5], state_values=state).first()
        assert (row["n"], row["q"]) == (2, [2.0])


def test_describe_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(2.0, None), (2.0, None)], "same double, gone double")
    rows = {r["column_name"]: r for r in describe_numeric(df).collect()}
    assert (rows["same"]["std"], rows["same"]["q50"], rows["same"]["n"]) == (0.0, 2.0, 2)
    assert rows["gone"]["n"] == 0 and rows["gone"]["q50"] is None


@pytest.mark.parametrize("bins", [1, 7, 20])
def test_histogram_equals_numpy(spark, bins):
    rng = np.random.default_rng(5)
    data = {"a": np.round(rng.uniform(0, 1, 3000), 2), "b": np.round(rng.normal(50, 9, 3000))}
    rows = histogram(_frame(spark, data), ["a", "b"], bins).collect()
    for name, values in data.items():
        got = {r["bin"]: r for r in rows if r["column_name"] == name}
        counts, edges = np.histogram(values, bins)
        assert [got[i + 1]["n"] for i in range(bins)] == counts.tolist()
        assert np.allclose([got[i + 1]["lo"] for i in range(bins)], edges[:-1])


def test_histogram_of_one_value(spark):
    rows = histogram(_frame(spark, {"a": [4.0, 4.0]}), ["a"], 4).collect()
    counts, edges = np.histogram([4.0, 4.0], 4)
    by_bin = sorted(rows, key=lambda r: r["bin"])
    assert [r["n"] for r in by_bin] == counts.tolist()
    assert by_bin[0]["lo"] == edges[0]


@pytest.mark.parametrize("state_values", [1, 10**6])
def test_box_figures(spark, state_values):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 1.0)], "g string, v double")
    rows = {r["g"]: r for r in box_by_group(df, "v", "g", state_values).collect()}
    row = rows["g"]
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)
    assert (row["whisker_lo"], row["whisker_hi"], row["n_outside"]) == (1.0, 5.0, 1)
    assert rows[None]["n"] == 1


def test_outliers_say_when_there_are_none(spark):
    df = _frame(spark, {"a": [1.0, 2.0, 3.0, 99.0, 2.0], "b": [1.0, 1.0, 1.0, 1.0, 1.0]})
    rows = {r["column_name"]: r for r in iqr_outliers(df).collect()}
    assert (rows["a"]["n_above"], rows["a"]["note"]) == (1, "")
    assert (rows["b"]["n_outliers"], rows["b"]["note"]) == (0, "не обнаружено")


def test_missing_group_keys_are_a_group(spark):
    rows = [(None, float(i)) for i in range(101)] + [("a", float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r["q"] for r in exact_quantiles(df, ["v"], [0.5], ["g"], 5).collect()}
    assert found == {None: [50.0], "a": [5.0]}


def test_large_column_is_never_one_aggregation_state(spark):
    df = spark.range(50_000).select((F.col("id") * 1.5).alias("v"))
    found = exact_quantiles(df, ["v"], [0.5], state_values=100)
    plan = found._jdf.queryExecution().toString()
    assert "percentile(" not in plan
    assert found.first()["q"] == [49_999 / 2 * 1.5]


def _gappy_rows(n=3000, columns=26, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, columns)) + 1e6 * rng.normal(size=columns)
    base[:, 1] += 3 * base[:, 0]
    base[rng.random((n, columns)) < 0.2] = np.nan
    base[:, 5] = 0.1
    base[~np.isnan(base[:, 6]), 7] = 0.3  # constant where column 6 is known
    base[:, 8] = np.nan
    return base


def test_correlations_of_gappy_columns_take_one_scan(spark):
    base = _gappy_rows()
    names = [f"c{i}" for i in range(base.shape[1])]
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in base]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(6)
    got = {(r.a, r.b): r.r for r in corr_pairs(df.mapInPandas(watched, df.schema)).collect()}
    assert seen.value <= 2 * len(base)
    want = pd.DataFrame(base, columns=names)
    assert len(got) == 26 * 25 // 2
    for (a, b), r in got.items():
        both = want[[a, b]].dropna()
        if len(both) == 0 or both.nunique().min() < 2:
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9), (a, b)


def test_correlations_of_nothing(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in corr_pairs(none).collect()] == [("a", "b", None)]
    assert corr_pairs(none.select("a")).count() == 0


def test_scatter_sample_does_not_depend_on_partitions(spark):
    rows = [(float(i % 40), float(i % 31), i) for i in range(2000)] + [(None, 1.0, 1), (float("nan"), 2.0, 1)]
    df = spark.createDataFrame(rows, "x double, y double, z long")
    some = sorted(map(tuple, scatter_sample(df, "x", "y", 100, seed=3).collect()))
    assert some == sorted(map(tuple, scatter_sample(df.repartition(7), "x", "y", 100, seed=3).collect()))
    assert len(some) == 100 and some != sorted(map(tuple, scatter_sample(df, "x", "y", 100, seed=4).collect()))
    every = {tuple(r) for r in scatter_points(df, "x", "y").collect()}
    assert set(some) < every
    assert {tuple(r) for r in scatter_sample(df, "x", "y", 10_000).collect()} == every
    cells = scatter_grid(df, "x", "y", 10).collect()
    assert len(cells) <= 100 and sum(c.n for c in cells) == 2000
