"""Large CSV files by several tasks: against the reader that takes a file in one piece, and against Python's."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.core import ROW_ID, EngineError
from lodeframe.operators import apply
from lodeframe.plans.identity import identified
from lodeframe.sources import readers
from lodeframe.sources.csv_records import after_line, csv_records, csv_shape, ragged


@pytest.fixture
def small_splits(spark):
    """Splits of 2 kB, so that small files have many."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def awkward(rows: int, seed: int, longest: int = 12) -> list[list[str]]:
    pick = random.Random(seed)
    parts = ["a", "é", '"', "\n", ",", ";", " ", '""', "x y", "\r\n", "7", "語"]
    cell = lambda: "".join(pick.choice(parts) for _ in range(pick.randint(1, longest))).strip() or "z"
    return [[str(i), f"{i / 4}", cell(), f"2024-01-{1 + i % 28:02d}", cell()] for i in range(rows)]


def put(path, rows, end="\n", quoting=csv.QUOTE_MINIMAL, mark=""):
    text = io.StringIO()
    csv.writer(text, lineterminator=end, quoting=quoting).writerows([["id", "q", "t", "d", "u"], *rows])
    path.write_bytes((mark + text.getvalue()).encode())
    return str(path)


def test_states_of_lines():
    assert after_line("a,b", ",", False) == (False, 1)
    assert after_line('a,"b', ",", False) == (True, 1)
    assert after_line('c","d', ",", True) == (True, 1)
    assert after_line('c""', ",", True) == (True, 0)
    assert after_line('"a""b",c"d,""', ",", False) == (False, 2)
    assert after_line('"a"x"y,b', ",", False) == (False, 1)
    assert after_line("", ",", True) == (True, 0)


@pytest.mark.parametrize(("end", "quoting", "mark"), [("\n", csv.QUOTE_MINIMAL, ""), ("\r\n", csv.QUOTE_ALL, "﻿")])
def test_same_cells_as_pythons_reader(spark, tmp_path, small_splits, end, quoting, mark):
    rows = awkward(700, 3)
    path = put(tmp_path / "a.csv", rows, end, quoting, mark)
    records = csv_records(spark, path)
    assert records.where("record >= 0").count() == len(rows) + 1
    out = readers.parsed(records, ",", ROW_ID)
    assert [f.dataType.simpleString() for f in out.schema][:4] == ["int", "double", "string", "date"]
    got = [(str(r["id"]), r["t"], r["u"], r[ROW_ID]) for r in out.orderBy(ROW_ID).collect()]
    assert got == [(r[0], r[2], r[4], i + 1) for i, r in enumerate(rows)]
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10


def test_same_table_as_the_whole_file_reader(spark, tmp_path, small_splits, monkeypatch):
    path = put(tmp_path / "a.csv", awkward(300, 5) + [["", "", "", "", ""], ["900", "1", "y", "", ""]])
    whole = readers.read_csv(spark, path)
    monkeypatch.setattr(readers, "LARGE", 0)
    split = readers.read_csv(spark, path)
    assert split.drop(ROW_ID).schema.simpleString() == whole.schema.simpleString()
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(split.orderBy(ROW_ID).drop(ROW_ID)) == rows(identified(whole).orderBy(ROW_ID).drop(ROW_ID))
    assert identified(split) is split


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    long = "\n".join(f'line {i}, "quoted"' for i in range(2000))
    path = put(tmp_path / "a.csv", [["1", "1", "s", "2024-01-01", long], ["2", "1", "s", "2024-01-01", "after"]])
    out = readers.parsed(csv_records(spark, path), ",", ROW_ID).orderBy(ROW_ID).collect()
    assert [(r["id"], r["u"]) for r in out] == [(1, long), (2, "after")]


def test_ragged_rows_are_named_by_line(spark, tmp_path, small_splits):
    lines = ["a,b,c", *[f'{i},"x\ny",z' for i in range(400)], "", "1,2", '"p\nq",2,3,4', ""]
    path = tmp_path / "a.csv"
    path.write_text("\n".join(lines))
    records = csv_records(spark, str(path))
    assert csv_shape(records).first().asDict() == {"rows": 402, "width": 4, "ragged_rows": 2}
    assert [(r["line"], r["width"]) for r in ragged(records).orderBy("line").collect()] == [(803, 2), (804, 4)]
    with pytest.raises(EngineError, match=r"line 803 \(2 instead of 3\), line 804 \(4 instead of 3\)"):
        readers.read_csv(spark, str(path), strict=True)


def test_an_open_quote_empty_files_and_headers_only(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"never\nclosed\n')
    assert [(r["record"], r["line"], r["text"]) for r in csv_records(spark, str(tmp_path / "open.csv")).orderBy("record").collect()] == [
        (0, 1, "a,b"),
        (1, 2, '1,"never\nclosed'),
    ]
    (tmp_path / "head.csv").write_text("a,b,,a\n\n\n")
    with pytest.raises(EngineError, match="the file is empty"):
        (tmp_path / "none.csv").write_text("")
        csv_records(spark, str(tmp_path / "none.csv"))
    df = readers.read_csv(spark, str(tmp_path / "head.csv"), ",", strict=True)
    assert df.columns == ["a0", "b", "_c2", "a3", ROW_ID] and df.count() == 0


def test_joined_files_have_ids_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "LARGE", 0)
    paths = [put(tmp_path / f"{n}.csv", awkward(20, n)) for n in (1, 2)]
    both = identified(readers.union_csv_files(spark, paths))
    assert both.count() == 40 and both.select(ROW_ID).distinct().count() == 40
    assert apply("rows.filter", both, conditions=[{"kind": "exact", "column": "id", "value": 3}]).df.count() == 2
    assert both.agg(F.max(ROW_ID)).first()[0] == 40


def test_a_folder_of_files(spark, tmp_path, small_splits, monkeypatch):
    (tmp_path / "d").mkdir()
    first, second = awkward(150, 8), [["x", "1", "t", "", ""]] + awkward(90, 9)
    put(tmp_path / "d" / "a.csv", first)
    put(tmp_path / "d" / "b.csv", second)
    monkeypatch.setattr(readers, "LARGE", 0)
    out = readers.read_csv(spark, str(tmp_path / "d"), ",").orderBy(ROW_ID).collect()
    assert [(r[ROW_ID], r["id"], r["u"]) for r in out] == [(i + 1, r[0], r[4] or None) for i, r in enumerate(first + second)]
    (tmp_path / "d" / "c.csv").write_text("id,q\n1,2\n")
    with pytest.raises(EngineError, match="different headers"):
        readers.read_csv(spark, str(tmp_path / "d"), ",")
