"""Records of a large CSV file by several tasks, though quoted cells may hold line ends.

Spark splits a text file by bytes, at line ends. Whether a split begins inside a quoted cell depends on all that lies before
it, but what a split does to that state doesn't: each split is summed up once for either beginning (its last state, its
lines, its records), and the sums, a row for each split, are put together in order. A second pass then knows how each split
begins and numbers its records. Records that cross splits are put together from their pieces, at most two for each split.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import EngineError
from ..functions.stored import stored

QUOTE = '"'
#: Ragged records that an error names.
NAMED = 10


def after_line(line: str, sep: str, inside: bool) -> tuple[bool, int]:
    """Whether a line that begins inside a quoted cell or not (at a record's beginning) ends inside one, and the separators
    outside of quotes. A quote opens a cell only where the cell begins; after the closing quote all is text up to the
    separator."""
    at = found = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True, found
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif line.startswith(QUOTE, at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False, found
        found, at = found + 1, at + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, start (the first byte of the line's split): the lines of a split in order, as one scan reads them."""
    place = (F.col(f"_metadata.{c}").alias(name) for c, name in (("file_path", "file"), ("file_block_start", "start")))
    return spark.read.option("lineSep", "\n").text(path).select("value", *place)


def _unmarked(line: str, start: int, first: bool) -> str:
    return line.removeprefix("\ufeff") if first and start == 0 else line


def split_sums(lines: DataFrame, sep: str) -> DataFrame:
    """A row for each split: file, start, lines, and for a beginning outside (0) and inside (1) of quotes whether it ends inside,
    the records and the blank lines that begin in it."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for line, file, start in zip(batch["value"], batch["file"], batch["start"], strict=True):
                own = sums.setdefault((file, start), [0, [False, True], [0, 0], [0, 0]])
                line = _unmarked(line, start, not own[0])
                own[0] += 1
                blank, quoted = line in ("", "\r"), QUOTE in line
                for s in (0, 1):
                    inside = own[1][s]
                    if not inside:
                        own[3 if blank else 2][s] += 1
                    if quoted:
                        own[1][s] = after_line(line, sep, inside)[0]
        rows = [(*at, n, *ends, *records, *blanks) for at, (n, ends, records, blanks) in sums.items()]
        yield pd.DataFrame(rows, columns=["file", "start", "lines", "ends0", "ends1", "records0", "records1", "blank0", "blank1"])

    schema = "file string, start long, lines long, ends0 boolean, ends1 boolean, records0 long, records1 long, blank0 long, blank1 long"
    return lines.mapInPandas(summed, schema)


def split_beginnings(sums: list) -> tuple[list[tuple[str, int, bool, int, int, int]], int]:
    """(file, start, inside, records before it in the file, lines before it there, rows of earlier files) of each split, and
    all blank lines."""
    found, rows, blank = [], 0, 0
    for file, own in groupby(sorted(sums, key=lambda s: (s["file"], s["start"])), key=lambda s: s["file"]):
        inside, records, lines = False, 0, 0
        for s in own:
            found.append((file, s["start"], inside, records, lines, rows))
            which = int(inside)
            inside, records, lines, blank = s[f"ends{which}"], records + s[f"records{which}"], lines + s["lines"], blank + s[f"blank{which}"]
        rows += max(0, records - 1)
    return found, blank


def _pieces(lines: DataFrame, sep: str) -> DataFrame:
    """Records, and pieces of those that cross splits, of lines with their splits' beginnings."""

    names = ["file", "record", "row", "line", "separators", "whole", "text"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of the split at hand: [its place, inside, records, lines, the open record's first line, its separators, its lines, from here]
        own, out = None, []

        def close(ended: bool) -> None:
            text = "\n".join(own[6])
            out.append((own[0][0], own[2] - 1, own[0][2] + own[2] - 1, own[4], own[5], ended and own[7], text.removesuffix("\r") if ended else text))

        for batch in batches:
            for line, file, start, inside, records, before, rows in zip(*[batch[c] for c in batch.columns], strict=True):
                first = own is None or own[0] != (file, start, rows)
                if first:
                    if own is not None and own[1]:
                        close(False)
                    own = [(file, start, rows), inside, records, before, before + 1, 0, [], False]
                line = _unmarked(line, start, first)
                own[3] += 1
                if not own[1]:
                    if line in ("", "\r"):
                        continue
                    own[2] += 1
                    own[4:] = [own[3], 0, [], True]
                own[1], found = after_line(line, sep, own[1]) if QUOTE in line else (own[1], 0 if own[1] else line.count(sep))
                own[5] += found
                own[6].append(line)
                if not own[1]:
                    close(True)
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if own is not None and own[1]:
            close(False)
            yield pd.DataFrame(out, columns=names)

    return lines.mapInPandas(cut, "file string, record long, row long, line long, separators long, whole boolean, text string")


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The records of a UTF-8 CSV file or a folder of such: file, record (0 is its header), row (from 1 for what follows the
    headers, file after file), line (where it begins, from 1), width (its cells) and text, as a stored table. Blank lines
    between records are none.

    Nothing but a row for each split of ``spark.sql.files.maxPartitionBytes`` comes to the driver and goes back to all tasks.
    A record has to fit into one row. A quoted cell that is never closed runs to the end of the file.
    """
    begins, _ = split_beginnings(split_sums(_lines(spark, path), sep).collect())
    if not begins:
        raise EngineError("the file is empty")
    table = spark.createDataFrame(begins, "file string, start long, inside boolean, records long, before long, rows long")
    known = _lines(spark, path).join(F.broadcast(table), ["file", "start"], "left")
    lost = F.raise_error("the file's splits have changed while it was read")
    inside = F.coalesce("inside", lost.cast("boolean")).alias("inside")
    known = known.select("value", "file", "start", inside, "records", "before", "rows")
    pieces = stored(_pieces(known, sep), "csv-pieces")
    piece = F.struct("line", "text")
    crossing = (
        pieces.where("NOT whole")
        .groupBy("file", "record", "row")
        .agg(
            F.min("line").alias("line"),
            (F.sum("separators") + 1).alias("width"),
            F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "\n").alias("text"),
        )
    )
    return pieces.where("whole").select("file", "record", "row", "line", (F.col("separators") + 1).alias("width"), "text").unionByName(crossing)


def csv_shape(records: DataFrame) -> DataFrame:
    """One row: rows (without the headers), width (of the widest record), and ragged_rows, whose width isn't the headers'."""
    heading = F.col("record") == 0
    by_width = records.groupBy("width").agg(F.count_if(~heading).alias("n"), F.max(heading).alias("heading"))
    header = by_width.agg(F.max(F.when(F.col("heading"), F.col("width"))).alias("header"))
    odd = F.when(F.col("width") != F.col("header"), F.col("n")).otherwise(0)
    return by_width.join(F.broadcast(header)).agg(
        F.sum("n").alias("rows"), F.max("width").alias("width"), F.sum(odd).alias("ragged_rows")
    )


def ragged(records: DataFrame) -> DataFrame:
    """file, record, line and width of the records that are wider or narrower than their header."""
    header = records.where("record = 0").select(F.col("file").alias("headed"), F.col("width").alias("header"))
    odd = (F.col("file") == F.col("headed")) & (F.col("width") != F.col("header"))
    return records.join(header, odd).select("file", "record", "line", "width", "header")


def reject_ragged(records: DataFrame) -> DataFrame:
    """``records``, or an error that names the first lines with too few or too many cells."""
    found = ragged(records).orderBy("file", "line").limit(NAMED).collect()
    if found:
        where = ", ".join(f"line {r['line']} ({r['width']} instead of {r['header']})" for r in found)
        raise EngineError(f"records of other widths than the header: {where}")
    return records


def header_names(text: str, sep: str) -> list[str]:
    """The names as Spark's reader gives them: places for empty ones, places behind those that occur twice."""
    raw = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep))
    folded = [h.lower() for h in raw]
    return [f"_c{i}" if not h else f"{h}{i}" if folded.count(h.lower()) > 1 else h for i, h in enumerate(raw)]


def parsed(records: DataFrame, sep: str, row_id: str) -> DataFrame:
    """The table that ``records`` make: types from all rows, ``row_id`` from 1 in the file's order."""
    spark = records.sparkSession
    header = records.where("record = 0").select("text").distinct().limit(2).collect()
    if len(header) != 1:
        raise EngineError("the files have different headers" if header else "the file has no header")
    names, body = header_names(header[0]["text"], sep), records.where("record > 0")
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "multiLine": "true"}
    # a record of empty cells in front tells the reader how many columns there are, and nothing about their types
    texts = spark.createDataFrame([(sep * (len(names) - 1),)], "text string").unionByName(body.select("text"))
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    inferred = DataFrame(spark.read.options(inferSchema="true", **options)._jreader.csv(strings), spark).schema
    types = [f.dataType.simpleString() for f in inferred][: len(names)]
    types += ["string"] * (len(names) - len(types))
    ddl = ", ".join(f"c{i} {t}" for i, t in enumerate(types))
    cells = body.select(F.col("row").alias("r"), F.from_csv("text", ddl, options).alias("c")).select("c.*", "r")
    return cells.toDF(*names, row_id)
