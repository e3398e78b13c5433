"""Whole-file workflows: merging, splitting and converting files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.core import EngineError
from ..operators import apply
from ..operators.tables import safe_table_name, united
from .readers import read_csv, read_csv_files, read_worksheet, sheet_names
from .writers import write_csv, write_workbook


def merge_csv_files(spark: SparkSession, sources: list[str], destination: str, schema_mode: str = "strict", source_column: str | None = None) -> Path:
    paths = {Path(s).name: s for s in sources}
    if len(paths) < len(sources):
        raise EngineError("files must differ in name")
    tables = read_csv_files(spark, paths)
    return write_csv(united(tables, schema_mode, source_column), destination)


def merge_worksheets(spark: SparkSession, sources: dict[str, list[str] | None], destination: str, schema_mode: str = "strict", source_column: str | None = None) -> Path:
    """sources: workbooks with the sheets to take (None: all)."""
    tables = {
        f"{Path(path).name}:{sheet}": read_worksheet(spark, path, sheet)
        for path, sheets in sources.items()
        for sheet in sheets or sheet_names(path)
    }
    return write_workbook({"Merged Data": united(tables, schema_mode, source_column)}, destination)


def split_to_workbook(df: DataFrame, destination: str, **parameters) -> Path:
    return write_workbook(apply("table.split_by_category", df, **parameters).aux, destination)


def csv_to_workbook(spark: SparkSession, source: str, destination: str) -> Path:
    return write_workbook({"Data": read_csv(spark, source)}, destination)


def workbook_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {s: read_worksheet(spark, path, s) for s in sheet_names(path)}


def rename_sheets(spark: SparkSession, source: str, destination: str, names: dict[str, str]) -> Path:
    return write_workbook({names.get(n, n): t for n, t in workbook_tables(spark, source).items()}, destination)


def add_summary_sheet(spark: SparkSession, source: str, destination: str, name: str, summary: DataFrame) -> Path:
    """A copy of the workbook's tables with one more."""
    tables = workbook_tables(spark, source)
    if name.casefold() in (n.casefold() for n in tables):
        raise EngineError(f"sheet {name!r} exists already")
    return write_workbook(tables | {name: summary}, destination)


def _taken_apart(spark: SparkSession, source: str, sheets: list[str] | None) -> dict[str, DataFrame]:
    if source.lower().endswith(".xlsm"):
        raise EngineError("workbooks with macros can't be taken apart")
    tables = workbook_tables(spark, source)
    missing = sorted(set(sheets or ()) - set(tables))
    if missing:
        raise EngineError("unknown sheets: " + ", ".join(missing))
    return {n: tables[n] for n in sheets or tables}


def export_sheets(spark: SparkSession, source: str, destination: str, sheets: list[str]) -> Path:
    return write_workbook(_taken_apart(spark, source, sheets), destination)


def split_workbook(spark: SparkSession, source: str, folder: str, sheets: list[str] | None = None) -> list[Path]:
    """A workbook for each sheet, named after the source and the sheet."""
    tables = _taken_apart(spark, source, sheets)
    Path(folder).mkdir(parents=True, exist_ok=True)
    stem, taken = Path(source).stem, set()
    return [write_workbook({n: t}, Path(folder) / f"{stem}_{safe_table_name(n, taken)}.xlsx") for n, t in tables.items()]
