"""Sources, sinks, moderation, models and the streaming job."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.plans import modelling, moderation, newton
from quillframe.sources import files, tables, verdict_files
from quillframe.streaming.moderation import current_verdicts, moderate_new_files


def _write(path: Path, content: bytes | str) -> str:
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(path)


def test_csv_types_and_missing_tokens(spark, tmp_path):
    path = _write(
        tmp_path / "t.csv",
        'n,x,flag,word,gone\n1,1.5,True,"a, ""b""",NA\n2,nan,False,None,\n3,2e1,True,"two\nlines",\n',
    )
    df = tables.read_csv_table(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == [
        "bigint", "double", "boolean", "string", "double"
    ]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [
        (1, 1.5, True, 'a, "b"', None), (2, None, False, None, None), (3, 20.0, True, "two\nlines", None),
    ]


def test_csv_schema_casts_whole_numbers_with_fraction(spark, tmp_path):
    path = _write(tmp_path / "t.csv", "id,target\n5,1.0\n6,0.0\n")
    df = tables.read_csv_table(spark, path, "id bigint, target int")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(5, 1), (6, 0)]


def test_csv_short_rows_are_filled_and_long_rows_refused(spark, tmp_path):
    short = _write(tmp_path / "s.csv", "a,b\n1\n2,3\n")
    assert [tuple(r) for r in tables.read_csv_table(spark, short).orderBy("a").collect()] == [
        (1, None), (2, 3)
    ]
    long = _write(tmp_path / "l.csv", 'a,b\n1,2\n"3,4",5,6\n')
    for columns in (["a"], ["a", "b"]):
        with pytest.raises(Exception, match="more fields than the header"):
            tables.read_csv_text(spark, long).select(*columns).collect()


def test_admission_in_order(spark, tmp_path):
    _write(tmp_path / "good.csv", "a,b\n1,2\n")
    _write(tmp_path / "empty.csv", "a,b\n")
    _write(tmp_path / "UPPER.CSV", "a\n1\n")
    _write(tmp_path / "notes.txt", "a\n1\n")
    _write(tmp_path / "big.csv", b"a\n" + b"1\n" * 700_000)
    _write(tmp_path / "book.xlsx", b"PK")
    rows = files.admit_files(spark, str(tmp_path), max_mb=1).collect()
    found = {Path(r["path"]).name: r["reason"] for r in rows}
    assert found == {
        "good.csv": None,
        "empty.csv": "Файл пуст.",
        "UPPER.CSV": "Поддерживаемые форматы: CSV, XLSX.",
        "notes.txt": "Поддерживаемые форматы: CSV, XLSX.",
        "big.csv": "Файл слишком большой (1.3 MB). Максимум: 1 MB.",
        "book.xlsx": "Ошибка чтения файла",
    }


def test_each_file_is_read_in_its_own_encoding(spark, tmp_path):
    _write(tmp_path / "u.csv", "id,word\n1,слово\n".encode("utf-8"))
    _write(tmp_path / "c.csv", "id,word\n2,слово\n".encode("cp1251"))
    _write(tmp_path / "l.csv", b"id,word\n3,caf\xe9\x98\n")
    df = files.read_admitted_csv(spark, str(tmp_path), "id bigint, word string")
    assert {(r["id"], r["encoding"], r["word"]) for r in df.collect()} == {
        (1, "utf-8", "слово"), (2, "cp1251", "слово"), (3, "latin-1", "café\x98"),
    }


def test_every_high_byte_decodes_as_in_python(spark):
    bytes_of = [bytes([0xFF, b]) for b in range(0x80, 0x100)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bytes_of)], "i int, content binary")
    rows = files.with_decoded_text(df).orderBy("i").collect()
    for raw, row in zip(bytes_of, rows, strict=True):
        assert raw.decode(row["encoding"]) == row["text"]
        assert row["encoding"] == ("latin-1" if raw[1] == 0x98 else "cp1251")


VERDICT_ROWS = [
    ("b", 0, "toxic", 'said "x"\nя'), ("a", 1, "non-toxic", "ok"), ("b", 2, "uncertain", "later\t\\"),
]


def test_verdict_object_is_one_json_document(spark, tmp_path):
    df = spark.createDataFrame(VERDICT_ROWS, "id string, row_no bigint, verdict string, reason string")
    out = tmp_path / "object"
    verdict_files.write_verdict_object(df.repartition(3), str(out))
    written = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    want = {r[0]: {"verdict": r[2], "reason": r[3]} for r in VERDICT_ROWS}
    assert written.rstrip("\n") == json.dumps(want, ensure_ascii=False, indent=2)


def test_verdict_rows_are_json_lines(spark, tmp_path):
    df = spark.createDataFrame(VERDICT_ROWS, "id string, row_no bigint, verdict string, reason string")
    verdict_files.write_verdict_rows(df, str(tmp_path / "rows"))
    back = spark.read.json(str(tmp_path / "rows"))
    assert {(r["id"], r["verdict"]) for r in back.collect()} == {("a", "non-toxic"), ("b", "uncertain")}


def _client_factory():
    """Answers by the comment; fails twice before it answers 'flaky'."""
    calls: dict[str, int] = {}

    def client(prompt: str) -> str:
        comment = prompt.rsplit("\n", 1)[1]
        calls[comment] = calls.get(comment, 0) + 1
        if comment == "flaky" and calls[comment] < 3:
            raise TimeoutError("slow")
        if comment == "garbage":
            return "no json"
        bad = "idiot" in comment
        return json.dumps({"verdict": "toxic" if bad else "non-toxic", "reason": comment})

    return client


COMMENTS = [
    ("1", "You are an idiot"), ("2", "Thanks for fixing this"), ("3", "flaky"), ("4", "garbage"),
    ("5", None), ("6", "first"), ("6", "second idiot"),
]


def test_moderation_of_a_comments_table(spark):
    df = spark.createDataFrame(COMMENTS, "code string, body string")
    found = {r["id"]: (r["verdict"], r["reason"]) for r in
             moderation.moderate(df, _client_factory).collect()}
    assert found["1"] == ("toxic", "You are an idiot")
    assert found["2"][0] == "non-toxic"
    assert found["3"] == ("non-toxic", "flaky")
    assert found["4"][0] == "uncertain" and found["4"][1].endswith("JSONDecodeError: no json")
    assert found["5"][0] == "uncertain" and "comment is missing" in found["5"][1]
    assert found["6"] == ("toxic", "second idiot")


def test_last_row_of_an_id_counts_by_file_then_place(spark, tmp_path):
    filler = "".join(f"{i},fine words here\n" for i in range(100, 3000))
    (tmp_path / "a.csv").write_text("code,body\n1,old\n")
    (tmp_path / "b.csv").write_text("code,body\n1,newer idiot\n" + filler + "2,first\n2,later idiot\n")
    df = spark.read.csv(str(tmp_path), header=True)
    found = {r["id"]: r["reason"] for r in moderation.moderate(df, _client_factory).collect()}
    assert found["1"] == "newer idiot" and found["2"] == "later idiot"


def test_rows_with_missing_numbers_are_scored(spark):
    rows = [(i, float(i % 7) if i % 4 else None, "a" if i % 3 else None, i % 2) for i in range(80)]
    rows += [(90, float("nan"), "b", 1)]
    df = spark.createDataFrame(rows, "i int, x double, c string, y int")
    for fit in (modelling.fit_logistic, modelling.fit_gbt):
        scored = modelling.with_score(fit(df, "y", ["x"], ["c"]), df)
        assert scored.count() == len(rows) and scored.where("score IS NULL").count() == 0


def test_stream_scores_each_file_once(spark, tmp_path):
    source, sink, progress = (tmp_path / n for n in ("in", "out", "progress"))
    source.mkdir()
    _write(source / "one.csv", "id,comment_text\na,You idiot\nb,hello\n")

    def run():
        moderate_new_files(
            spark, str(source), str(sink), _client_factory, str(progress)
        ).awaitTermination()
        return {r["id"]: r["verdict"] for r in spark.read.json(str(sink)).collect()}

    assert run() == {"a": "toxic", "b": "non-toxic"}
    _write(source / "two.csv", "id,comment_text\nc,fine\n")
    assert run() == {"a": "toxic", "b": "non-toxic", "c": "non-toxic"}
    assert spark.read.json(str(sink)).count() == 3


@pytest.mark.parametrize("merge_every", [1, 2, 3, 16])
def test_stream_keeps_the_newest_verdict_of_an_id(spark, tmp_path, merge_every):
    source, sink, progress = (tmp_path / n for n in ("in", "out", "progress"))
    source.mkdir()
    loads = [
        "a,You idiot,5\nb,hello,1\nc,idiot,\n",
        "a,late and older,4\nb,idiot,2\nb,fine,3\n",
        "c,ordered now,1\na,newest,6\n",
        "d,alone,\n",
        "a,You idiot,6\n",
    ]
    for i, load in enumerate(loads):  # each run is a restart
        _write(source / f"{i}.csv", "id,comment_text,no\n" + load)
        moderate_new_files(
            spark, str(source), str(sink), _client_factory, str(progress), order="no", merge_every=merge_every
        ).awaitTermination()
    found = {r["id"]: (r["verdict"], r["reason"]) for r in current_verdicts(spark, str(sink)).collect()}
    assert found == {
        "a": ("toxic", "You idiot"), "b": ("non-toxic", "fine"),
        "c": ("non-toxic", "ordered now"), "d": ("non-toxic", "alone"),
    }
    assert current_verdicts(spark, str(sink)).count() == 4
    # Merged folders replace older ones.
    kept = sorted(int(p.name[6:]) for p in sink.glob("batch=*"))
    assert kept == {1: [3, 4], 2: [3, 4], 3: [2, 3, 4], 16: [0, 1, 2, 3, 4]}[merge_every]
    assert current_verdicts(spark, str(tmp_path / "nothing")).count() == 0


def test_a_repeated_batch_of_the_stream_changes_nothing(spark, tmp_path):
    source, sink, progress = (tmp_path / n for n in ("in", "out", "progress"))
    source.mkdir()

    def run():
        moderate_new_files(
            spark, str(source), str(sink), _client_factory, str(progress), merge_every=2
        ).awaitTermination()
        return {(r["id"], r["verdict"]) for r in current_verdicts(spark, str(sink)).collect()}

    _write(source / "0.csv", "id,comment_text\na,idiot\nb,idiot\n")
    run()
    _write(source / "1.csv", "id,comment_text\na,fine\n")
    want = {("a", "non-toxic"), ("b", "toxic")}
    assert run() == want
    # As if the run had been cut off before it noted that batch 1 was done.
    for name in ("1", ".1.crc"):
        (progress / "commits" / name).unlink()
    assert run() == want
    assert sorted(p.name for p in sink.glob("batch=*")) == ["batch=0", "batch=1"]


def test_newton_steps_by_plain_sums(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [1, 20, 0.1] + [0, 5, 3]
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(x[:, 0] - 0.1 * x[:, 1])))).astype(int)
    rows = [(int(a), *map(float, b), 7.0) for a, b in zip(y, x)] + [(None, 1.0, 1.0, 1.0, 7.0)]
    rows += [(1, float("nan"), None, 3.0, 7.0)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double, same double").repartition(5)
    model = newton.fit_newton(df, "y", ["a", "b", "c", "same"], steps=7)
    frame = df.where("y IS NOT NULL").toPandas()
    z = frame[["a", "b", "c"]]
    z = ((z - z.mean()) / z.std()).fillna(0).to_numpy()
    z, t, w = np.column_stack([np.ones(len(z)), z]), frame["y"].to_numpy(), np.zeros(4)
    for _ in range(7):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z, z.T @ (t - p))
    assert np.allclose(model.weights, [*w, 0.0], atol=1e-8)
    scored = newton.with_newton_score(model, df)
    assert scored.where("score IS NULL").count() == 0
    got = np.array(sorted(r["score"] for r in scored.where("y IS NOT NULL").collect()))
    assert np.allclose(got, sorted(1 / (1 + np.exp(-z @ w))))
    none = newton.fit_newton(df.limit(0), "y", ["a"])
    assert none.weights == (0.0, 0.0)


def test_text_scores_have_three_bands(spark):
    rows = [(f"you are an idiot number {i}", 1) for i in range(12)]
    rows += [(f"thanks for fixing this item {i}", 0) for i in range(30)]
    model = moderation.train_toxicity(spark.createDataFrame(rows, "t string, y int"), "t", "y")
    new = spark.createDataFrame([("you idiot",), ("thanks for fixing",), (None,), ("ok lol",)], "t string")
    scored = moderation.score_text(new, model, "t", 0.3, 0.7).collect()
    assert [r["verdict"] for r in scored][:3] == ["toxic", "non-toxic", "uncertain"]
    assert scored[2]["t"] is None


@pytest.mark.parametrize("levels", [3, 5000])
def test_f1_and_auc_by_brute_force(spark, monkeypatch, levels):
    rng = np.random.default_rng(8)
    y = (rng.uniform(size=1500) < 0.3).astype(int)
    s = np.floor(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 0.999) * levels) / levels
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    monkeypatch.setattr(modelling, "_CUT_ROWS", 300)
    row = modelling.f1_auc(df, "y", "s").first()
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    assert np.isclose(row["auc"], ((pos > neg) + 0.5 * (pos == neg)).mean())
    said = s >= 0.5
    assert np.isclose(row["f1"], 2 * (said & (y == 1)).sum() / (said.sum() + y.sum()))


def test_auc_of_one_class_is_missing(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert modelling.f1_auc(df, "y", "s").first()["auc"] is None


@pytest.mark.parametrize("fit", [modelling.fit_logistic, modelling.fit_gbt])
def test_models_learn_an_easy_target(spark, fit):
    rng = np.random.default_rng(9)
    x = rng.normal(size=400)
    rows = [(float(a), "u" if a > 0.2 else "v", int(a > 0)) for a in x]
    df = spark.createDataFrame(rows, "x double, c string, y int")
    scored = modelling.with_score(fit(df, "y", ["x"], ["c"]), df)
    assert modelling.f1_auc(scored, "y", "score").first()["auc"] > 0.95
    assert scored.columns == ["x", "c", "y", "score"]
    assert scored.where(F.col("score").isNull()).count() == 0
