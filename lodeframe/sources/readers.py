"""Readers: CSV with a sniffed delimiter, Parquet, and worksheets by the standard library."""

from __future__ import annotations

import csv
import re
import zipfile
from datetime import date, datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import ROW_ID, EngineError, check_names
from ..functions.profile import headers
from .csv_records import csv_records, parsed, reject_ragged

#: Name of the one table of a CSV or Parquet file.
ONLY = {".csv": "CSV", ".parquet": "Parquet"}
# Namespaces of workbooks.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: A CSV file of more bytes is read by several tasks, though its quoted cells may hold line ends.
LARGE = 32 << 20
#: Guards for archives: members, bytes of one, bytes of all, times the packed size.
ARCHIVE_LIMITS = (10_000, 256 << 20, 1 << 30, 200)


def first_bytes(spark: SparkSession, path: str, size: int = 8192) -> bytes:
    """The beginning of a file, or of the first one of a folder, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place) and fs.getFileStatus(place).isDirectory():
        place = jvm.org.apache.hadoop.fs.Path(min(spark.read.text(path).inputFiles()))
    stream = fs.open(place)
    try:
        out = bytearray()
        while len(out) < size and (b := stream.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        stream.close()


def sniffed_delimiter(head: bytes) -> str:
    """Comma, semicolon, tab or pipe; comma if it can't be told."""
    text = head.decode("utf-8-sig", errors="replace")
    try:
        return csv.Sniffer().sniff(text, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as long, other numbers as double."""
    casts = {T.IntegerType: "bigint", T.ShortType: "bigint", T.ByteType: "bigint", T.FloatType: "double", T.DecimalType: "double"}
    return df.select(
        *[
            F.col("`" + f.name.replace("`", "``") + "`").cast(casts.get(type(f.dataType), f.dataType)).alias(f.name)
            for f in df.schema
        ]
    )


def _is_large(spark: SparkSession, path: str) -> bool:
    """Whether a path is a file or folder that several tasks should read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(place) and fs.getContentSummary(place).getLength() > LARGE


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, strict: bool = False) -> DataFrame:
    """UTF-8 with a header; types from all rows, ISO dates as dates, empty cells as null.

    A large file or folder is read by several tasks and has its row ids; smaller ones, and files whose lines end with carriage
    returns alone, go to a task each. ``strict`` refuses rows with more or fewer cells than the header, by their lines.
    """
    head = first_bytes(spark, path)
    sep = delimiter or sniffed_delimiter(head)
    if strict or (_is_large(spark, path) and not (b"\r" in head and b"\n" not in head)):
        records = csv_records(spark, path, sep)
        return check_names(widened(parsed(reject_ragged(records) if strict else records, sep, ROW_ID)))
    df = spark.read.options(header=True, inferSchema=True, multiLine=True, sep=sep, quote='"', escape='"', enforceSchema=False).csv(path)
    return check_names(widened(df))


def _cell_column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def guarded(path: str | Path) -> zipfile.ZipFile:
    """An archive that isn't a bomb and holds nothing outside itself."""
    archive = zipfile.ZipFile(path)
    members, one, total, ratio = ARCHIVE_LIMITS
    found = archive.infolist()
    size = sum(m.file_size for m in found)
    if len(found) > members or any(m.file_size > one for m in found) or size > total:
        raise EngineError("the archive is too large")
    if size > ratio * max(1, sum(m.compress_size for m in found)):
        raise EngineError("the archive is packed too tightly")
    if any(m.filename.startswith(("/", "\\")) or ".." in Path(m.filename).parts for m in found):
        raise EngineError("the archive holds unsafe names")
    return archive


def sheet_names(path: str | Path) -> list[str]:
    with guarded(path) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]


def worksheet_rows(path: str | Path, sheet: str | None = None) -> list[list]:
    """Cells of a worksheet; formulas stay texts that begin with '='."""
    with guarded(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(RELATION)] for s in book.iter(f"{MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise EngineError(f"no sheet {sheet!r}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        dated = _dated(z)
        since = datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{MAIN}workbookPr")) else datetime(1899, 12, 30)
        rows = []
        body = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
        for row in body.iter(f"{MAIN}row"):
            cells: list = []
            for c in row.iter(f"{MAIN}c"):
                at = _cell_column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value, formula, how = c.findtext(f"{MAIN}v"), c.findtext(f"{MAIN}f"), c.get("t", "n")
                if formula is not None:
                    cells[at] = "=" + formula
                elif how == "s" and value is not None:
                    cells[at] = shared[int(value)]
                elif how == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif how == "b":
                    cells[at] = value == "1"
                elif value is not None and how == "n" and int(c.get("s", "0")) in dated:
                    moment = since + timedelta(seconds=round(float(value) * 86_400, 3))
                    cells[at] = moment if dated[int(c.get("s", "0"))] else moment.date()
                elif value is not None:
                    cells[at] = value if how in ("str", "e") else float(value) if re.search(r"[.eE]", value) else int(value)
            rows.append(cells)
        return rows


def _dated(z: zipfile.ZipFile) -> dict[int, bool]:
    """The cell styles that show numbers as dates, and whether with a time of day."""
    if "xl/styles.xml" not in z.namelist():
        return {}
    sheet = ElementTree.fromstring(z.read("xl/styles.xml"))
    # The numbers of the format's own date formats, those with a time among them.
    known = {i: i == 22 for i in (14, 15, 16, 17, 22)}
    for f in sheet.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        if "y" in code or "d" in code:
            known[int(f.get("numFmtId"))] = "h" in code
    cells = sheet.find(f"{MAIN}cellXfs")
    of = {i: int(x.get("numFmtId", "0")) for i, x in enumerate(cells if cells is not None else [])}
    return {i: known[n] for i, n in of.items() if n in known}


def read_worksheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Row 1 names the columns; a column of one type has it, any other is text; blank rows are left out. A worksheet has
    2**20 rows at most, so that it is parsed on the driver."""
    rows = worksheet_rows(path, sheet)
    width = max((len(r) for r in rows), default=0)
    names, repeated = headers([None if x is None else str(x) for x in (rows[0] if rows else [])], width)
    if repeated or not width or any(x is None or not str(x).strip() for x in rows[0] + [None] * (width - len(rows[0]))):
        raise EngineError("headers must be filled and differ")
    body = [r + [None] * (width - len(r)) for r in rows[1:]]
    body = [r for r in body if any(x is not None for x in r)]
    fields = []
    for i, name in enumerate(names):
        kinds = {type(r[i]) for r in body if r[i] is not None}
        if kinds == {bool}:
            t: T.DataType = T.BooleanType()
        elif kinds == {int}:
            t = T.LongType()
        elif kinds and kinds <= {int, float}:
            t = T.DoubleType()
        elif kinds == {date}:
            t = T.DateType()
        elif kinds == {datetime}:
            t = T.TimestampType()
        else:
            t = T.StringType()
        for r in body:
            if r[i] is not None:
                r[i] = float(r[i]) if isinstance(t, T.DoubleType) else str(r[i]) if isinstance(t, T.StringType) else r[i]
        fields.append(T.StructField(name, t))
    return check_names(spark.createDataFrame(body, T.StructType(fields)))


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    suffix = Path(path).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix in (".xlsx", ".xlsm"):
        return read_worksheet(spark, path, sheet)
    if suffix == ".parquet":
        return check_names(spark.read.parquet(path))
    raise EngineError(f"files of type {suffix!r} can't be read")


def table_names(path: str) -> list[str]:
    suffix = Path(path).suffix.lower()
    return [ONLY[suffix]] if suffix in ONLY else sheet_names(path)


def read_csv_files(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of CSV files by their names; if any has row ids, all have, file after file."""
    from ..plans.identity import apart

    tables = {name: read_csv(spark, p) for name, p in paths.items()}
    return apart(tables) if any(ROW_ID in df.columns for df in tables.values()) else tables


def union_csv_files(spark: SparkSession, paths: list[str], union_by_name: bool = True) -> DataFrame:
    from ..operators.tables import united

    return united(read_csv_files(spark, {p: p for p in paths}), "union" if union_by_name else "strict")


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    return spark.createDataFrame(frame)


def to_pandas(df: DataFrame):
    return df.toPandas()
