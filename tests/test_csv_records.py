"""CSV records over ranges, and files as rows."""

import io
import random
from pathlib import Path

import pandas as pd
import pytest

from quillframe.functions import fixed_values as V
from quillframe.sources import files, tables
from quillframe.sources.csv_records import cells, column_names, open_after, records_of
from quillframe.support import scratch_path


def _cell(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return rng.choice(["", '""', '"a ""quoted"" word"'])
    if kind == 1:
        return '"' + "\n".join(rng.choice(["x", "", ",", 'say ""hi""', "é漢"]) for _ in range(rng.randrange(1, 9))) + '"'
    if kind == 2:
        return '5" pipe'
    if kind == 3:
        return '"tail"after'
    return rng.choice(["plain", "12", " spaced ", "-1.5", "NA"])


def _text(rng, rows, line="\n"):
    body = [",".join(_cell(rng) for _ in range(3)) + f",{i}" for i in range(rows)]
    return line.join(["a,b,c,no", *body]) + rng.choice(["", line, line + line])


def _plain(text):
    """Character by character."""
    rows, row, cell, state = [], [], "", "start"
    for c in text + "\n":
        if state == "open":
            if c == '"':
                state = "quote"
            else:
                cell += c
            continue
        if state == "quote" and c == '"':
            cell += '"'
            state = "open"
            continue
        if c == '"' and state == "start":
            state = "open"
        elif c == ",":
            row.append(cell)
            cell, state = "", "start"
        elif c == "\n":
            row.append(cell.removesuffix("\r"))
            if any(x.strip() for x in row) or len(row) > 1:
                rows.append(row)
            row, cell, state = [], "", "start"
        else:
            cell += c
            state = "rest"
    return rows


def test_records_against_reading_each_character():
    rng = random.Random(6)
    for _ in range(400):
        text = _text(rng, rng.randrange(12), rng.choice(["\n", "\r\n"]))
        assert [cells(r) for r in records_of(text)] == _plain(text), text


def test_records_agree_with_pandas_where_it_is_strict():
    text = 'id,word\n1,"two\nlines"\n2,"a, ""b"""\n\n3,\n'
    want = pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False).values.tolist()
    assert [cells(r) for r in records_of(text)][1:] == want


def test_open_cells():
    assert open_after('1,"a', False) and not open_after('1,"a"', False) and not open_after('1,a"', False)
    assert open_after("more", True) and not open_after('end",2', True) and open_after('end","again', True)
    assert open_after('say ""hi""', True) and not open_after('"', True)
    with pytest.raises(ValueError):
        list(records_of('a\n"never closed\n'))
    assert cells('a\rb,"c""d",e') == ["a\rb", 'c"d', "e"]
    assert column_names("﻿a,,a,a") == ["a", "Unnamed: 1", "a.1", "a.2"]


@pytest.mark.parametrize("bytes_a_range", ["64", "300", "1m"])
def test_large_files_are_read_in_ranges(spark, tmp_path, bytes_a_range):
    rng = random.Random(int(bytes_a_range.removesuffix("m")))
    want = []
    for n in range(3):
        text = _text(rng, 150, rng.choice(["\n", "\r\n"]))
        (tmp_path / f"t{n}.csv").write_bytes(text.encode())
        want += _plain(text)[1:]
    long = '"' + "line\n" * 400 + '"'
    (tmp_path / "long.csv").write_text(f"no,c,b,a\n-1,{long},2,3\n-2,x\n")
    want += [["3", "2", "line\n" * 400, "-1"], [None, None, "x", "-2"]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_range)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = tables.read_csv_text(spark, str(tmp_path))
        if bytes_a_range != "1m":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 4
        got = [[r.a, r.b, r.c, r.no] for r in read.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [[None if c in tables.V.MISSING_TOKENS else c for c in r] for r in want]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_cell_never_closed_and_a_folder_without_header(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(ValueError, match="not closed"):
        tables.read_csv_text(spark, str(tmp_path))
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "t.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="no header"):
        tables.read_csv_text(spark, str(tmp_path / "n"))


def test_admission_opens_files(spark, tmp_path):
    given = {
        "good.csv": b'a,b\n1,"x\ny"\n\n2,z\n',
        "no bytes.csv": b"",
        "blank.csv": b"\n \n",
        "long row.csv": b"a,b\n1,2\n1,2,3\n",
        "open.csv": b'a,b\n1,"x\n',
        "header.csv": b"a,b\n",
        "cp.csv": "а,б\n1,\"да\"\n".encode("cp1251"),
        "bom.csv": b"\xef\xbb\xbfa,b\n1,2\n",
        "empty.txt": b"",
    }
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    read, none, kind = tables.V.REJECT_READ, tables.V.REJECT_EMPTY, tables.V.REJECT_EXTENSION
    found = {Path(r["path"]).name: (r["rows"], r["reason"]) for r in files.admit_files(spark, str(tmp_path)).collect()}
    assert found == {
        "good.csv": (2, None), "no bytes.csv": (None, read), "blank.csv": (None, read), "long row.csv": (None, read),
        "open.csv": (None, read), "header.csv": (0, none), "cp.csv": (1, None), "bom.csv": (1, None),
        "empty.txt": (None, kind),
    }


def test_admitted_rows_are_matched_by_name_and_typed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,a,price\n"x, y",1,2.505\n"two\nlines",2.0,NA\n3\n')
    (tmp_path / "b.csv").write_text("﻿a,b\n9223372036854775807,z\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,2,3\n")
    df = files.read_admitted_csv(spark, str(tmp_path), "a bigint, b string, price decimal(10,2)")
    assert [f.dataType.simpleString() for f in df.schema][3:] == ["bigint", "string", "decimal(10,2)"]
    got = sorted((Path(r["path"]).name, r["row_no"], r["a"], r["b"], str(r["price"])) for r in df.collect())
    assert got == [
        ("a.csv", 0, 1, "x, y", "2.51"), ("a.csv", 1, 2, "two\nlines", "None"), ("a.csv", 2, None, "3", "None"),
        ("b.csv", 0, 2**63 - 1, "z", "None"),
    ]


def test_many_small_files_go_to_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    n = 32 * 12 * cores
    path = scratch_path(spark, "many")
    rows = spark.range(n).selectExpr(
        "CASE id % 4 WHEN 0 THEN concat('a b+', id, '%.csv') WHEN 1 THEN concat('é&', id, '.csv') ELSE concat(id, '.txt') END AS name",
        "encode(CASE WHEN id % 8 < 2 THEN '' WHEN id % 4 = 3 THEN '' ELSE 'id\\n7\\n' END, 'UTF-8') AS content",
    )
    files.write_files(rows, path)
    found = files.admit_files(spark, path)
    got = found.groupBy("length", "rows", "reason").count().collect()
    assert {(r["length"], r["rows"], r["reason"], r["count"]) for r in got} == {
        (5, 1, None, n // 4), (0, None, V.REJECT_READ, n // 4), (5, None, V.REJECT_EXTENSION, n // 4), (0, None, V.REJECT_EXTENSION, n // 4),
    }
    read = files.read_admitted_csv(spark, path, "id bigint")
    assert read.filter("id = 7").count() == read.count() == n // 4
    assert read.rdd.getNumPartitions() <= 4 * cores
