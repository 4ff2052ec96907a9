"""Profiles, groups, correlations, transcripts, splits on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe import support
from quillframe.operators import (
    charts,
    correlation,
    features,
    groups,
    profile,
    sampling,
    transcripts,
    verdicts,
)
from quillframe.plans import auto_report as auto
from quillframe.functions.report import parse_report, report_quality


@pytest.fixture(scope="module")
def health(spark):
    rng = np.random.default_rng(11)
    n = 600
    sick = (rng.uniform(size=n) < 0.6).astype(int)
    hdl, ldl, tri = rng.normal(54, 8, n), rng.normal(103, 18, n), rng.normal(123, 25, n)
    frame = pd.DataFrame(
        {
            "id": np.arange(n) * 7 + 3,
            "age": rng.integers(20, 80, n),
            "bmi": rng.normal(25.6, 2.5, n).round(1),
            "activity": rng.gamma(2, 40, n).round() - 10 * sick + 20,
            "cholesterol": hdl + ldl + tri / 5 + rng.normal(0, 1, n),
            "hdl": hdl, "ldl": ldl, "tri": tri,
            "gender": rng.choice(["Female", "Male", "Other"], n, p=[0.5, 0.45, 0.05]),
            "family": (rng.uniform(size=n) < 0.15 + 0.2 * sick).astype(int),
            "diagnosed": sick,
        }
    )
    return frame, spark.createDataFrame(frame).repartition(4).cache()


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_describe_equals_pandas(health):
    frame, df = health
    found = _by(profile.describe_numeric(df), "column_name")
    want = frame.describe()
    for c in want.columns:
        got = [found[c][k] for k in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")]
        assert np.allclose(got, want[c].to_numpy())


def test_missing_counts_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "")], "x double, t string")
    assert {r[0]: r[1] for r in profile.null_counts(df).collect()} == {"x": 2, "t": 1}


def test_roles(health):
    _, df = health
    roles = {r["column_name"]: r["role"] for r in profile.column_roles(df).collect()}
    assert roles == {
        "id": "technical", "age": "numeric", "bmi": "numeric", "activity": "numeric",
        "cholesterol": "numeric", "hdl": "numeric", "ldl": "numeric", "tri": "numeric",
        "gender": "categorical", "family": "binary", "diagnosed": "binary",
    }


def test_nearly_unique_column_is_not_technical(spark):
    df = spark.createDataFrame([(i if i else 1, str(i)) for i in range(100)], "a int, b string")
    assert [r["role"] for r in profile.column_roles(df).collect()] == ["numeric", "technical"]


def test_correlation_matrix_equals_pandas(health):
    frame, df = health
    want = frame.corr(numeric_only=True)
    found = correlation.corr_long(df).collect()
    assert len(found) == want.size
    for r in found:
        assert np.isclose(r["r"], want.loc[r["a"], r["b"]])


def test_correlation_skips_missing_pairs_and_constants(spark):
    nan = float("nan")
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 1.0, 5.0), (nan, 9.0, 5.0), (4.0, 7.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, same double")
    found = {(r["a"], r["b"]): r["r"] for r in correlation.corr_pairs(df).collect()}
    frame = pd.DataFrame(rows, columns=["a", "b", "same"])
    assert np.isclose(found["a", "b"], frame["a"].corr(frame["b"]))
    assert found["a", "same"] is None and found["b", "same"] is None
    assert correlation.top_corr_pair(df).first()["b"] == "b"


def test_top_features_order(health):
    frame, df = health
    found = [r["feature"] for r in correlation.top_features(df, "diagnosed", 3).collect()]
    want = frame.corr(numeric_only=True)["diagnosed"].drop("diagnosed").abs()
    assert found == want.sort_values(ascending=False).index[:3].tolist()


def test_class_balance_weights_and_missing_target(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] + [(None,)], "y int")
    balance = _by(groups.class_balance(df, "y"), "class")
    assert (balance[1]["n"], balance[1]["share"]) == (3, 0.75)
    weights = _by(groups.class_weights(df, "y"), "class")
    assert weights[0]["weight"] == 2.0 and np.isclose(weights[1]["weight"], 2 / 3)
    assert groups.with_class_weight(df, "y").where("y = 0").first()["weight"] == 2.0


def test_group_difference_names_both_bases(spark):
    df = spark.createDataFrame([(1, 73.5), (0, 91.4)], "y int, activity double")
    row = groups.group_diff(df, F.col("y") == 1, ["activity"]).first()
    assert round(100 * row["diff_to_out"], 1) == -19.6
    assert round(100 * row["diff_to_in"], 1) == -24.4


def test_group_means_and_prevalence(health):
    frame, df = health
    found = {(r["class"], r["column_name"]): r for r in
             groups.group_means(df, "diagnosed", ["bmi", "age"]).collect()}
    want = frame.groupby("diagnosed")[["bmi", "age"]].mean()
    for y in (0, 1):
        assert np.isclose(found[y, "bmi"]["mean"], want.loc[y, "bmi"])
    rows = {(r["dimension"], r["value"]): r for r in
            groups.prevalence(df, "diagnosed", ["family", "gender"]).collect()}
    for value, part in frame.groupby("gender"):
        assert np.isclose(rows["gender", value]["prevalence"], part["diagnosed"].mean())
    spread = groups.prevalence_spread(df, "diagnosed", ["family", "gender"]).collect()
    assert {r["place"] for r in spread} == {1, 2}


def test_identity_residual(health):
    _, df = health
    row = profile.identity_residual(
        df, F.col("cholesterol"), F.col("hdl") + F.col("ldl") + F.col("tri") / 5
    ).first()
    assert abs(row["mean_residual"]) < 0.2 and row["r_squared"] > 0.99


def test_bands_and_truncation(spark):
    df = spark.createDataFrame([(42.0,), (60.0,), (101.0,), (None,)], "rate double")
    bands = {"rate": [("slow", None, 60), ("usual", 60, 100), ("fast", 100, None)]}
    assert {r["band"]: r["n"] for r in profile.band_counts(df, bands).collect()} == {
        "slow": 1, "usual": 1, "fast": 1
    }
    row = profile.range_truncation(df, {"rate": (42, 220)}).first()
    assert (row["cut_below"], row["cut_above"]) == (False, True)


def test_schema_block(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a bigint, b double, c string, d boolean")
    assert profile.schema_block(df).first()[0] == (
        "Размер: 1 строк × 4 столбцов\nСтолбцы и типы:\n"
        "  - a: int64\n  - b: float64\n  - c: object\n  - d: bool"
    )


def test_chart_quota_keeps_the_first(spark):
    specs = spark.createDataFrame([("run", i) for i in range(30)] + [("b", 1)], "run string, n int")
    kept = charts.chart_quota(specs, "run", "n")
    assert sorted(r["n"] for r in kept.where("run = 'run'").collect()) == list(range(8))
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_auto_report_reads_back_complete(health):
    _, df = health
    report = auto.auto_report(df, "diagnosed", ["age", "bmi", "activity", "hdl", "tri"])
    written = auto.report_text(report)
    sections = written.select(parse_report(F.col("text")).alias("s"))
    quality = sections.select(report_quality(F.col("s"), F.lit(3)).alias("q")).first()["q"]
    assert quality["complete"]
    assert sections.first()["s"][1]["title"] == "КЛЮЧЕВЫЕ ЦИФРЫ"


@pytest.mark.parametrize("columns, dims", [(["age"], ["gender"]), (["age", "bmi"], []), (["age"], ["gender", "family"])])
def test_reports_have_five_findings_with_numbers(health, spark, columns, dims):
    frame, df = health
    some = df.select(*columns, *dims, "diagnosed")
    if "bmi" in columns:
        some = some.withColumn("bmi", F.when(F.col("age") > 30, F.col("bmi")))
    report = auto.auto_report(some, "diagnosed", columns, dims)
    found = report.where("section_no = 3").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, len(found) + 1)) and len(found) >= 5
    assert all(any(c.isdigit() for c in r["text"]) for r in found)
    young = int((frame["age"] <= 30).sum())
    gaps = found[len(columns)]
    assert gaps["value"] == (young if "bmi" in columns else 0)
    rates = frame.groupby("gender")["diagnosed"].mean()
    for r in found[len(found) - len(dims) :]:
        if r["text"].startswith("gender"):
            assert np.isclose(r["value"], 100 * (rates.max() - rates.min()))
            assert f"({rates.idxmin()}) до " in r["text"] and f"({rates.idxmax()}), " in r["text"]
    empty = auto.auto_report(some.limit(0), "diagnosed", columns, dims)
    assert empty.where("section_no = 3").count() == len(found) - len(dims)


# ---- transcripts -----------------------------------------------------------

@pytest.fixture(scope="module")
def chat(spark):
    """One conversation holds a third of the messages."""
    rows = [(0, t, "user" if t % 2 else "assistant", f"hot {t}") for t in range(500)]
    rows += [(c, t, "assistant", f"{c} {t}") for c in range(1, 101) for t in range(10)]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(6)


@pytest.mark.parametrize("slice_rows", [7, 64, 10**6])
def test_positions_do_not_depend_on_slices(chat, slice_rows):
    placed = transcripts.assemble_transcript(chat, slice_rows=slice_rows)
    assert placed.count() == 1500
    assert placed.where("position <> turn + 1").count() == 0
    calls = F.when(F.col("role") == "user", 1).otherwise(0)
    counted = transcripts.running_count(chat, "conv_id", "turn", calls, "calls", slice_rows)
    wrong = counted.where("conv_id = 0 AND calls <> floor((turn + 1) / 2)")
    assert wrong.count() == 0


def test_long_conversations_continue_in_parts(chat):
    packed = transcripts.pack_transcripts(chat, pack=200, slice_rows=64)
    hot = sorted(packed.where("conv_id = 0").collect(), key=lambda r: r["part"])
    assert [len(r["messages"]) for r in hot] == [200, 200, 100]
    said = [m["content"] for r in hot for m in r["messages"]]
    assert said == [f"hot {t}" for t in range(500)]
    assert packed.where("conv_id > 0").count() == 100


def test_outcomes(spark):
    rows = [
        ("a", 1, "tool_call", None), ("a", 2, "final", " done "),
        ("b", 1, "model_error", None), ("b", 2, "forced_final", "x"),
        ("c", 1, "final", "  "), ("c", 2, "forced_final", "x"),
        ("d", 1, "tool_call", None), ("d", 2, "forced_final", "x"),
        ("e", 1, "final", ""), ("e", 2, "forced_final", " "),
        ("f", 1, "tool_call", None),
    ]
    trace = spark.createDataFrame(rows, "conv_id string, turn int, type string, text string")
    assert {r["conv_id"]: r["outcome"] for r in transcripts.run_outcome(trace).collect()} == {
        "a": "final", "b": "forced_after_error", "c": "forced_after_empty",
        "d": "forced_after_cap", "e": "no_report", "f": "no_report",
    }


def test_steps_count_calls_only(spark):
    rows = [("r", i, t) for i, t in enumerate(
        ["tool_call", "model_error", "unknown_tool", "tool_call", "final"])]
    trace = spark.createDataFrame(rows, "conv_id string, turn int, type string")
    steps = transcripts.number_steps(trace).orderBy("turn").collect()
    assert [r["step"] for r in steps] == [1, None, 2, 3, None]


# ---- verdict rows ----------------------------------------------------------

def test_first_valid_attempt(spark):
    ok = '{"verdict":"toxic","reason":"r%d"}'
    rows = [("now", 0, ok % 0, None), ("now", 1, ok % 1, None)]
    rows += [("later", i, None, f"Timeout: {i}") for i in range(3)] + [("later", 3, ok % 3, None)]
    rows += [("never", i, "nope", None) for i in range(5)] + [("never", 5, "[1]", None)]
    rows += [("late", i, "nope", None) for i in range(6)] + [("late", 6, ok % 6, None)]
    rows += [("bad", 0, None, "Timeout: 0")]
    df = spark.createDataFrame(rows, "id string, attempt int, raw string, error string")
    found = {r["id"]: (r["verdict"], r["reason"]) for r in verdicts.first_valid_attempt(df).collect()}
    prefix = "не удалось получить корректный ответ после 6 попыток: "
    assert found == {
        "now": ("toxic", "r0"), "later": ("toxic", "r3"),
        "never": ("uncertain", prefix + "схема не соответствует: [1]"),
        "late": ("uncertain", prefix + "JSONDecodeError: nope"),
        "bad": ("uncertain", prefix + "Timeout: 0"),
    }


def test_newest_row_keeps_the_first_place(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z")], "id string, n int, v string")
    found = verdicts.newest_per_id(df, "id", "n").collect()
    assert {(r["id"], r["place"], r["v"]) for r in found} == {("a", 0, "z"), ("b", 1, "y")}


# ---- sampling, features ----------------------------------------------------

def test_block_is_contiguous_and_checked(spark):
    df = spark.range(10_050).repartition(5)
    block = [r["id"] for r in sampling.sample_block(df, ["id"], 7).collect()]
    assert sorted(block) == list(range(700, 800))
    with pytest.raises(IndexError):
        sampling.sample_block(df, ["id"], 100)
    with pytest.raises(ValueError):
        sampling.sample_block(df, ["id"], 101)
    assert sampling.sample_block(df, ["id"], 100, strict=False).count() == 50


@pytest.mark.parametrize("share,slices", [(0.2, 65_536), (0.5, 4), (0.0, 16), (1.0, 16)])
def test_split_is_exact_per_class(spark, share, slices):
    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else None)) for i in range(900)]
    df = spark.createDataFrame(rows, "k bigint, y string").repartition(4)
    collide = F.pmod(F.col("k") * 48271, F.lit(97)) * 1_000_000
    split = features.stratified_split(df, "y", "k", share, collide, slices)
    got = {(r["k"], r["part"]) for r in split.collect()}
    assert len(got) == 900
    frame = pd.DataFrame(rows, columns=["k", "y"])
    frame["h"] = frame["k"] * 48271 % 97 * 1_000_000
    for _, part in frame.groupby("y", dropna=False):
        ordered = part.sort_values(["h", "k"])["k"].tolist()
        cut = int(len(ordered) * share)
        assert {(k, "test") for k in ordered[:cut]} | {(k, "train") for k in ordered[cut:]} <= got


def test_split_repeats_with_the_default_hash(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("y"))
    one = features.stratified_split(df, "y", "id").collect()
    two = features.stratified_split(df.repartition(7), "y", "id").collect()
    assert set(one) == set(two)


def test_feature_preparation(health):
    frame, df = health
    scaled = features.standardize(df, ["bmi"]).select("bmi").toPandas()["bmi"]
    assert abs(scaled.mean()) < 1e-9 and np.isclose(scaled.std(), 1)
    coded = features.one_hot(df, "gender")
    assert coded.agg(F.sum("gender_Male")).first()[0] == (frame["gender"] == "Male").sum()
    crossed = features.interactions(df, [("age", "bmi")]).select("age_x_bmi").toPandas()
    assert np.isclose(crossed["age_x_bmi"].sum(), (frame["age"] * frame["bmi"]).sum())


def test_split_where_most_rows_have_one_hash(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 > 0, "hot").otherwise("rare").alias("y"))
    split = features.stratified_split(df.repartition(6), "y", "id", 0.3, F.lit(77))
    tested = {r["id"] for r in split.where("part = 'test'").collect()}
    hot, rare = ([i for i in range(5000) if (i % 5 > 0) == of] for of in (True, False))
    assert tested == {*hot[:1200], *rare[:300]}


def test_one_hot_vectors_of_many_values(spark):
    rows = spark.range(100_300).select(
        "id", F.when(F.col("id") < 100_000, F.format_string("v%06d", "id")).when(F.col("id") % 2 == 0, "v000007").alias("c")
    )
    coded = features.one_hot_vector(rows.repartition(7), "c", "v").where("id % 997 = 0 OR id >= 100_000".replace("_", ""))
    for r in coded.collect():
        want = [r["id"]] if r["id"] < 100_000 else [7] if r["id"] % 2 == 0 else []
        assert r["v"].size == 100_000 and r["v"].indices.tolist() == want and r["v"].values.tolist() == [1.0] * len(want)
    assert features.one_hot_vector(rows.limit(0), "c").count() == 0
    numbers = {r["c"]: r["number"] for r in features.category_numbers(spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "c string"), "c").collect()}
    assert numbers == {"a": 0, "b": 1}


def test_digests_that_collide_are_looked_up(spark):
    """Lengths as digests: one column repeats none, one repeats where the lowest digest does not."""
    df = spark.createDataFrame([("aa", "x", 1, 1), ("bb", "y", 2, 2), ("cc", "zz", 3, 2), ("dd", "zz", 4, 4)], "a string, b string, c int, d int")
    length = lambda c: F.length(c).cast("bigint")
    found = profile._repeating(df, list(df.schema), length)
    assert [f.name for f in found] == ["b", "d"]
    assert [f.name for f in profile._repeating(df, list(df.schema))] == ["b", "d"]


def test_one_job_for_all_candidates_for_a_key(spark):
    def jobs(width: int) -> int:
        df = spark.range(500).select(*[(F.col("id") * (i + 1)).alias(f"k{i}") for i in range(width)])
        group = f"roles-{width}"
        spark.sparkContext.setJobGroup(group, group)
        roles = profile.column_roles(df)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r["role"] for r in roles.collect()} == {"technical"}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert 0 < jobs(2) == jobs(20)


def test_one_hot_refuses_too_many_values(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CATEGORIES", 3)
    with pytest.raises(ValueError):
        features.one_hot(spark.createDataFrame([(c,) for c in "abcd"], "c string"), "c")


def test_feature_selection_reasons(health):
    _, df = health
    wide = df.withColumn("age_months", F.col("age") * 12)
    rows = {r["column_name"]: r["reason"] for r in
            features.feature_select(wide, "diagnosed").collect()}
    assert rows["id"] == "technical"
    assert rows["age_months"] == "collinear"
    assert rows["family"] == ""


# ---- helpers ---------------------------------------------------------------

def test_large_sides_are_not_broadcast(spark):
    small = support.small_or_cut(spark.range(5))
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    large = support.small_or_cut(spark.range(500), max_rows=10)
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert large.count() == 500


def test_own_folder_only_where_none_is_named(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert support.shared_dir(spark) == named

    class Unnamed:
        class conf:
            get = staticmethod(lambda key, default: default)

    assert support.shared_dir(Unnamed) == support.shared_dir(Unnamed)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: "yarn" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        support.shared_dir(Cluster)


def test_nan_target_is_missing(spark):
    rows = [(1.0, "p", 2.0), (0.0, "p", float("nan")), (float("nan"), "q", 1.0), (None, "q", 3.0)]
    df = spark.createDataFrame(rows, "y double, d string, x double")
    assert {r["class"]: r["n"] for r in groups.class_balance(df, "y").collect()} == {1.0: 1, 0.0: 1}
    assert {r["class"]: r["weight"] for r in groups.class_weights(df, "y").collect()} == {1.0: 1, 0.0: 1}
    rates = {r["value"]: (r["n"], r["prevalence"]) for r in groups.prevalence(df, "y", ["d"]).collect()}
    assert rates == {"p": (2, 0.5), "q": (0, None)}
    assert profile.identity_residual(df, F.col("x"), F.col("x")).first()["n"] == 3
    assert features.interactions(df, [("y", "x")]).where("y_x_x IS NULL").count() == 3
    assert features.standardize(df, ["x"]).where("x IS NULL").count() == 1


def test_joins_stay_right_without_broadcast(health, monkeypatch):
    frame, df = health
    for module in (groups, features):
        monkeypatch.setattr(module, "small_or_cut", lambda d: support.cut_lineage(d))
    monkeypatch.setattr(support, "_small", lambda d, max_rows=0: None)
    boxes = {r["gender"]: r for r in charts.box_by_group(df, "bmi", "gender").collect()}
    for value, part in frame.groupby("gender"):
        assert np.isclose(boxes[value]["median"], part["bmi"].median())
    split = features.stratified_split(df, "diagnosed", "id", 0.25)
    tested = split.where("part = 'test'").groupBy("diagnosed").count().collect()
    for row in tested:
        assert row["count"] == int((frame["diagnosed"] == row["diagnosed"]).sum() * 0.25)
