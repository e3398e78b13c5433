"""New workbooks, their formulas, and workflows on sheets."""

import re
import zipfile
from datetime import date, datetime
from xml.etree import ElementTree

import pytest

from lodeframe.functions.core import EngineError
from lodeframe.plans.runner import approve, execute, preview
from lodeframe.plans.schema import OperationPlan
from lodeframe.sources import workflows
from lodeframe.sources.formulas import FormulaSpec
from lodeframe.sources.readers import read_worksheet, table_names, worksheet_rows
from lodeframe.sources.writers import write_tables, write_workbook


def part(path, name):
    with zipfile.ZipFile(path) as z:
        return z.read(name).decode()


@pytest.fixture
def goods(spark):
    return spark.createDataFrame(
        [("=x & <y>", 2, 1.5, date(2026, 7, 17), datetime(2026, 7, 17, 6, 30), True), (None, 3, None, None, None, None), ("bell\x07", 4, 2.0, date(1999, 12, 31), None, False)],
        "Name string, Qty long, Price double, Day date, At timestamp, Ok boolean",
    )


def test_looks_of_a_new_workbook(goods, tmp_path):
    path = write_workbook({"Goods": goods, "Empty": goods.limit(0)}, tmp_path / "a.xlsx")
    for name in zipfile.ZipFile(path).namelist():
        ElementTree.fromstring(part(path, name))  # well-formed
    sheet, styles = part(path, "xl/worksheets/sheet1.xml"), part(path, "xl/styles.xml")
    assert 'state="frozen"' in sheet and '<autoFilter ref="A1:F4"/>' in sheet and 'orientation="landscape"' in sheet and "containsBlanks" in sheet
    assert re.search(r'<c r="A1" s="1"[^>]*><is><t[^>]*>Name<', sheet) and "<b/>" in styles and 'formatCode="yyyy-mm-dd"' in styles
    widths = [float(w) for w in re.findall(r' width="([0-9.]+)"', sheet)]
    assert len(widths) == 6 and min(widths) >= 10 and max(widths) <= 42
    back = read_worksheet(goods.sparkSession, str(path), "Goods")
    assert back.dtypes[3:5] == [("Day", "date"), ("At", "timestamp")]
    rows = back.collect()
    assert rows[0]["Name"] == "'=x & <y>" and rows[0]["Day"] == date(2026, 7, 17) and rows[0]["At"] == datetime(2026, 7, 17, 6, 30) and rows[0]["Ok"] is True
    assert rows[2]["Name"] == "bell" and rows[1]["Name"] is None and table_names(str(path)) == ["Goods", "Empty"]
    assert len(worksheet_rows(path, "Empty")) == 1
    with pytest.raises(EngineError):
        write_workbook({}, tmp_path / "none.xlsx")
    with pytest.raises(EngineError):
        write_workbook({"x": goods}, path)


def test_formula_columns(goods, tmp_path):
    specs = [
        FormulaSpec(output_column="Total", kind="quantity_price", operand_columns=["Qty", "Price"], number_format="0.00"),
        FormulaSpec(output_column="With tax", kind="gst", operand_columns=["Total"], rate_percent=18, include_base=True),
    ]
    path = write_workbook({"Goods": goods}, tmp_path / "a.xlsx", {"Goods": specs})
    rows = worksheet_rows(path, "Goods")
    assert rows[0][6:] == ["Total", "With tax"]
    assert [r[6:] for r in rows[1:]] == [[f"=B{n}*C{n}", f"=G{n}+G{n}*18.0/100"] for n in (2, 3, 4)]
    assert 'formatCode="0.00"' in part(path, "xl/styles.xml")
    bad = FormulaSpec(output_column="X", kind="addition", operand_columns=["Nothing"])
    with pytest.raises(EngineError):
        write_workbook({"Goods": goods}, tmp_path / "b.xlsx", {"Goods": [bad]})
    assert not (tmp_path / "b.xlsx").exists()


def test_workflows_on_sheets(spark, goods, tmp_path):
    source = str(write_workbook({"One": goods, "Two": goods.select("Qty")}, tmp_path / "book.xlsx"))
    summary = spark.createDataFrame([(3,)], "Rows long")
    out = workflows.add_summary_sheet(spark, source, str(tmp_path / "more.xlsx"), "Summary", summary)
    assert table_names(str(out)) == ["One", "Two", "Summary"] and worksheet_rows(out, "Summary") == [["Rows"], [3]]
    with pytest.raises(EngineError):
        workflows.add_summary_sheet(spark, source, str(tmp_path / "x.xlsx"), "one", summary)
    files = workflows.split_workbook(spark, source, str(tmp_path / "parts"))
    assert [f.name for f in files] == ["book_One.xlsx", "book_Two.xlsx"] and worksheet_rows(files[1], "Two")[1:] == [[2], [3], [4]]
    assert table_names(str(workflows.export_sheets(spark, source, str(tmp_path / "two.xlsx"), ["Two"]))) == ["Two"]
    merged = workflows.merge_worksheets(spark, {source: ["Two"], str(files[1]): None}, str(tmp_path / "merged.xlsx"))
    assert len(worksheet_rows(merged, "Merged Data")) == 7
    assert len(worksheet_rows(workflows.split_to_workbook(goods, str(tmp_path / "split.xlsx"), category_column="Ok"), table_names(str(tmp_path / "split.xlsx"))[0])) >= 2
    (tmp_path / "c.csv").write_text("a,b\n1,x\n")
    assert worksheet_rows(workflows.csv_to_workbook(spark, str(tmp_path / "c.csv"), str(tmp_path / "c.xlsx")), "Data") == [["a", "b"], [1, "x"]]
    for call in (lambda: workflows.export_sheets(spark, source, str(tmp_path / "n.xlsx"), ["No"]), lambda: workflows.split_workbook(spark, "m.xlsm", str(tmp_path))):
        with pytest.raises(EngineError):
            call()


@pytest.mark.parametrize("retained", [True, False])
def test_a_plan_retains_its_formulas(spark, goods, tmp_path, retained):
    source = "11111111-1111-1111-1111-111111111111"
    action = {"kind": "quantity_price", "output": "Total", "quantity_column": "Qty", "price_column": "Price"}
    gone = {"kind": "addition", "output": "Sum", "operands": [{"column": "Qty"}, {"column": "Price"}]}
    step = lambda i, operation, parameters, **more: {"step_id": i, "operation": operation, "parameters": parameters, "target": {"source_id": source}, "explanation": "x", **more}
    plan = OperationPlan.model_validate(
        {
            "job_name": "j",
            "source_files": [{"source_id": source, "file_name": "g.csv", "sha256": "0" * 64}],
            "steps": [
                step("a", "calculate.column", {"action": action}),
                step("b", "calculate.column", {"action": gone}),
                step("c", "columns.transform", {"actions": [{"kind": "rename", "mapping": {"Sum": "Both"}}]}),
            ],
            "output": {"output_name": "out", "format": "xlsx", "retain_calculation_formulas": retained},
        }
    )
    from uuid import UUID

    tables = {(UUID(source), "CSV"): goods.select("Qty", "Price")}
    seen = preview(plan, tables)
    write = lambda t, folder, **more: write_tables(t, folder, "xlsx", **more)
    execute(plan, tables, seen, approve(seen), tmp_path / "out", write)
    rows = worksheet_rows(tmp_path / "out" / "tables.xlsx", "CSV")
    at = rows[0].index("Total")
    assert [r[at] for r in rows[1:2]] == (["=A2*B2"] if retained else [3])
    assert sorted(rows[0]) == ["Both", "Price", "Qty", "Total"]
