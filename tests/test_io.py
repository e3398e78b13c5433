"""Reading, writing, profiling and scalar services."""

import zipfile

import pytest

from lodeframe.functions import profile, scalars
from lodeframe.functions.core import EngineError, qcol
from lodeframe.operators import apply
from lodeframe.plans.identity import identified
from lodeframe.sources import readers, workflows, writers
from lodeframe.streaming import apply_to_stream


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=2+2", 1, None), ('a"b\nc', 2, 1.5)], "`=P` string, Q int, R double").coalesce(1)
    path = writers.write_csv(df, tmp_path / "a.csv")
    raw = path.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf'=P,Q,R\n'=2+2,1,\n") and b"\r" not in raw
    back = readers.read_csv(spark, str(path))
    assert back.dtypes == [("'=P", "string"), ("Q", "bigint"), ("R", "double")]
    assert [tuple(r) for r in back.collect()] == [("'=2+2", 1, None), ('a"b\nc', 2, 1.5)]
    with pytest.raises(EngineError):
        writers.write_csv(df, path)
    writers.check_output(path, {"a": 2})


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    (tmp_path / "a.csv").write_text(sep.join("ABC") + "\n" + sep.join(["1", "2026-01-02", "x"]) + "\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "date", "string"]


def test_workbook_round_trip(spark, tmp_path):
    tables = {"One": spark.createDataFrame([(1, "x<&", True), (2, None, False)], "A int, B string, C boolean").coalesce(1), "Two/": spark.createDataFrame([(1.5,)], "V double")}
    path = writers.write_workbook(tables, tmp_path / "b.xlsx")
    assert readers.table_names(str(path)) == ["One", "Two_"]
    one = readers.read_table(spark, str(path), "One")
    assert one.dtypes == [("A", "bigint"), ("B", "string"), ("C", "boolean")] and [tuple(r) for r in one.collect()] == [(1, "x<&", True), (2, None, False)]
    writers.check_output(path, {"One": 2, "Two_": 1})
    renamed = workflows.rename_sheets(spark, str(path), tmp_path / "c.xlsx", {"One": "Uno"})
    assert readers.sheet_names(renamed) == ["Uno", "Two_"]
    with pytest.raises(EngineError):
        readers.read_table(spark, str(path), "None")


def test_bad_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", b"0" * 5_000_000)
    with pytest.raises(EngineError, match="tightly"):
        readers.guarded(tmp_path / "x.xlsx")
    with zipfile.ZipFile(tmp_path / "y.xlsx", "w") as z:
        z.writestr("../a", b"x")
    with pytest.raises(EngineError, match="unsafe"):
        readers.guarded(tmp_path / "y.xlsx")


def test_merging_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("ID,Name\n1,a\n")
    (tmp_path / "two.csv").write_text("ID,Value\n2,9\n")
    out = workflows.merge_csv_files(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], tmp_path / "m.csv", "union", "File")
    assert out.read_text("utf-8-sig") == "ID,Name,File,Value\n1,a,one.csv,\n2,,two.csv,9\n"
    with pytest.raises(EngineError):
        workflows.merge_csv_files(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")], tmp_path / "n.csv")
    assert readers.union_csv_files(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]).count() == 2


def test_profile(spark):
    rows = [("a@b.co", "123", "2026-01-01", "=1"), ("x@", "98765 43210", "soon", " "), (None, None, None, None), (None, None, None, None), ("a@b.co", "123", "2026-01-01", "=1")]
    df = spark.createDataFrame(rows, "Email string, Mobile string, DOB string, Payload string")
    found = {r["name"]: r for r in profile.profile_columns(df).collect()}
    assert found["Email"]["suspicious_email_count"] == 1 and found["Mobile"]["suspicious_phone_count"] == 2
    assert found["DOB"]["invalid_date_count"] == 1 and found["Payload"]["formula_injection_count"] == 2
    assert found["Mobile"]["mixed_types"] and found["Payload"]["blank_percentage"] == 60.0
    counts = profile.profile_rows(df).first().asDict()
    assert counts == {"data_rows": 5, "blank_rows": 2, "duplicate_rows": 1}
    warned = profile.table_warnings([r.asDict() for r in found.values()], counts, [])
    assert profile.risk(warned) == "high" and ("invalid_dates", "warning") in warned
    assert profile.headers([" A ", None, "a"], 4) == (["A", "Column_2", "a", "Column_4"], ["A", "a"])
    spelled = spark.createDataFrame([("New York",), ("new  york",), ("New-York",), ("Rome",)], "C string")
    assert profile.variations(spelled, ["C"]) == {"C": (2, 3)}


def test_profile_counts_variations(spark):
    rows = [("New York", 1, "x"), ("new  york", 2, "y"), ("New-York", 3, "z"), ("Rome", 4, None)]
    df = spark.createDataFrame(rows, "`a.C` string, n int, other string")
    found = {r["name"]: r.asDict() for r in profile.profile_columns(df).collect()}
    got = {n: (r["inconsistent_category_count"], r["possible_spelling_variation_count"]) for n, r in found.items()}
    assert got == {"a.C": (2, 3), "n": (0, 0), "other": (0, 0)}
    counts = {"blank_rows": 0, "duplicate_rows": 0}
    assert profile.table_warnings(list(found.values()), counts, []) == [("category_variations", "info")]
    assert profile.table_warnings([found["n"], found["other"]], counts, []) == []


@pytest.mark.parametrize("text", ["=SUM(A1:A2)", "+cmd", "-1+2", "@lookup", " \t=x", "﻿=x", "​@x", "＝x"])
def test_formula_guard(spark, text):
    df = spark.createDataFrame([(text,), ("plain",), (None,), ("'=x",)], "t string")
    got = [tuple(r) for r in df.select(scalars.starts_formula(qcol("t")), scalars.neutral(qcol("t"))).collect()]
    assert got == [(True, "'" + text), (False, "plain"), (False, None), (False, "'=x")]
    assert scalars.neutral_text(text) == "'" + text


def test_redaction_and_fingerprints(tmp_path):
    assert scalars.redact({"note": "mail a@b.co", "Password": "x", "n": [1, "+49 30 1234567"]}) == {"note": "mail [REDACTED]", "Password": "[REDACTED]", "n": [1, "[REDACTED]"]}
    (tmp_path / "a").write_text("x")
    before = scalars.fingerprint(tmp_path / "a")
    scalars.verify_unchanged(tmp_path / "a", before)
    (tmp_path / "a").write_text("y")
    with pytest.raises(EngineError):
        scalars.verify_unchanged(tmp_path / "a", before)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(" a ", 1), ("b", 2)], "T string, V int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("T string, V int").parquet(f"{tmp_path}/in")
    out = apply_to_stream(stream, "text.clean", columns=["T"], actions=[{"kind": "trim"}])
    out = apply_to_stream(out, "calculate.column", action={"kind": "gst", "output": "G", "base_column": "V", "rate_percent": 50})
    query = out.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("cleaned").collect()) == [("a", 1, 0.5), ("b", 2, 1.0)]
    with pytest.raises(EngineError):
        apply_to_stream(stream, "rows.sort", keys=[{"column": "T"}])


def test_columns_and_spellings_over_streams(spark, tmp_path):
    rows = [("Ada;x", " A@B.co ", "1,5"), ("Bo", "nobody", "7")]
    spark.createDataFrame(rows, "T string, M string, N string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("T string, M string, N string").parquet(f"{tmp_path}/in")
    actions = [
        {"kind": "split", "source": "T", "delimiter": ";", "output_columns": ["A", "B"], "keep_source": False},
        {"kind": "deterministic_id", "output": "I", "columns": ["A"]},
        {"kind": "lookup", "source": "A", "output": "L", "mapping": {"Ada": "x"}, "unmatched_policy": "null"},
        {"kind": "combine", "columns": ["A", "L"], "output": "C", "delimiter": "-"},
        {"kind": "rename", "mapping": {"M": "Mail"}},
        {"kind": "add", "name": "K", "value": 1},
        {"kind": "reorder", "columns": ["C"]},
    ]
    steps = [("columns.transform", {"actions": actions}), ("values.standardize", {"column": "Mail", "mode": "email"})]
    steps.append(("values.standardize", {"column": "N", "mode": "numeric_text", "invalid_policy": "null"}))
    whole, out = spark.read.parquet(f"{tmp_path}/in"), stream
    for operation, parameters in steps:
        whole, out = apply(operation, whole, **parameters).df, apply_to_stream(out, operation, **parameters)
    assert out.isStreaming and out.columns == whole.columns
    query = out.writeStream.format("memory").queryName("columns").trigger(availableNow=True).start()
    query.awaitTermination()
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(spark.table("columns")) == told(whole) and len(told(whole)) == 2
    for operation, parameters in (
        ("columns.transform", {"actions": [{"kind": "row_number"}]}),
        ("columns.transform", {"actions": [actions[2] | {"unmatched_policy": "reject"}]}),
        ("values.standardize", {"column": "M", "mode": "email", "invalid_policy": "reject"}),
        ("values.standardize", {"column": "N", "mode": "numeric_text"}),
    ):
        with pytest.raises(EngineError, match="stream"):
            apply_to_stream(stream, operation, **parameters)


def test_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "lodeframe", tmp_path / "lodeframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    queries, sql = map(int, said.stdout.split())
    assert queries > 50 and queries - sql <= 3
