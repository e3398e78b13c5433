"""Row identity: a hidden number for each row, given once when a table is loaded."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ROW_ID, position
from ..functions.stored import stored

#: Files whose first row ids are sent to all tasks; of more, they are joined by shuffle.
BROADCAST_FILES = 100_000


def ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` dealt into ranges of an order, numbered in __lf_range, as a stored table: a task that is run again, or a
    reader after it, finds every row in the range that it was counted in."""
    return stored(df.repartitionByRange(*order).withColumn("__lf_range", F.spark_partition_id()), name)


def starts(ranges: DataFrame, figure: Column) -> Column:
    """Over a table of ranged(): the sum of ``figure`` over all ranges before a row's own. A number for each range meets
    on the driver."""
    sums = {r["__lf_range"]: r["n"] or 0 for r in ranges.groupBy("__lf_range").agg(figure.alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sums, default=0) + 1):
        before.append(total)
        total += sums.get(part, 0)
    return F.get(F.lit(before), F.col("__lf_range"))


def dense(df: DataFrame, output: str, order: list[Column], start: int = 1, step: int = 1) -> DataFrame:
    """``output`` counts the rows in an order. Rows are dealt into ranges of the order and counted range by range, so
    that no task sees more than its range; only the ranges' sizes meet in one place."""
    dealt = ranged(df, order, "ranges")
    place = F.row_number().over(Window.partitionBy("__lf_range").orderBy(*order)) - 1 + starts(dealt, F.count(F.lit(1)))
    return dealt.withColumn(output, (F.lit(start) + F.lit(step) * place).cast("long")).drop("__lf_range")


def _is_whole_files(df: DataFrame) -> bool:
    """Whether a table is what files hold, row for row: columns of nothing but one relation of Parquet files. What its
    plan says is asked node by node; filters, unions, joins, samples and generators make it another table."""
    node = df._jdf.queryExecution().analyzed()
    while (kind := node.getClass().getSimpleName()) in ("Project", "SubqueryAlias"):
        node = node.child()
    if kind != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def _by_files(df: DataFrame, offset: int) -> DataFrame | None:
    """Row ids by the places of rows in whole Parquet files, in the order of their paths; None for any other table."""
    if not _is_whole_files(df):
        return None
    try:
        rows = df.withColumns({"__lf_file": F.col("_metadata.file_path"), "__lf_index": F.col("_metadata.row_index")})
        files = rows.groupBy("__lf_file").agg(F.count("__lf_index").alias("n"), F.max("__lf_index").alias("last")).orderBy("__lf_file").collect()
    except AnalysisException:  # a column of the name _metadata hides the files' own
        return None
    firsts, total = [], offset + 1
    for f in files:
        if f["last"] is None or f["n"] != f["last"] + 1:  # a file that is read twice
            return None
        firsts.append((f["__lf_file"], total))
        total += f["n"]
    if len(firsts) == 1:
        return rows.withColumn(ROW_ID, F.col("__lf_index") + firsts[0][1]).drop("__lf_file", "__lf_index")
    table = df.sparkSession.createDataFrame(firsts, "__lf_of string, __lf_first long")
    table = F.broadcast(table) if len(firsts) <= BROADCAST_FILES else table
    joined = rows.join(table, F.col("__lf_file") == F.col("__lf_of"))
    return joined.withColumn(ROW_ID, F.col("__lf_index") + F.col("__lf_first")).drop("__lf_file", "__lf_index", "__lf_of", "__lf_first")


def identified(df: DataFrame, offset: int = 0) -> DataFrame:
    """``df`` with the hidden row id, in its reader's order and from offset + 1.

    Rows of whole Parquet files are known by their places there, which reads no columns to count. Any other table is
    stored first: how its rows fall into partitions may change when it is run again.
    """
    if ROW_ID in df.columns:
        return df
    found = _by_files(df, offset)
    if found is not None:
        return found
    rows = stored(df.withColumns({"__lf_at": F.monotonically_increasing_id(), "__lf_range": F.spark_partition_id()}), "rows")
    place = F.col("__lf_at") - F.shiftleft(F.col("__lf_range").cast("long"), 33)
    return rows.withColumn(ROW_ID, (starts(rows, F.count(F.lit(1))) + place + 1 + offset).cast("long")).drop("__lf_at", "__lf_range")


def numbered(df: DataFrame, output: str, start: int = 1, step: int = 1) -> DataFrame:
    """``df`` with the rows' positions in their present order."""
    if ROW_ID not in df.columns:
        df = identified(df)
    return dense(df, output, [position(df)], start, step)


def apart(tables: dict[object, DataFrame]) -> dict[object, DataFrame]:
    """The tables with row ids that no two rows share, table after table. Ids that a table has already are moved up only if
    they don't lie behind those of the tables before it."""
    out, last = {}, 0
    for key, df in tables.items():
        if ROW_ID in df.columns and len(tables) > 1:
            low, high = df.agg(F.min(ROW_ID), F.max(ROW_ID)).first()
            by = last if low is not None and low <= last else 0
            out[key] = df.withColumn(ROW_ID, F.col(ROW_ID) + F.lit(by)) if by else df
            last = max(last, (high or 0) + by)
        else:
            out[key] = identified(df, last)
            last += df.count() if len(tables) > 1 else 0
    return out
