"""Reconciliation of a result with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import ROW_ID, is_numeric, kind, num, qcol, visible


def row_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows_before, rows_after, rows_changed, rows_added, rows_removed. A row has changed if any cell differs or
    the columns do."""
    same = visible(before) == visible(after)
    pick = lambda df, mark: df.select(qcol(ROW_ID).alias(f"{mark}_id"), F.struct(*[qcol(c).cast("string") for c in sorted(visible(df))]).alias(mark))
    joined = pick(before, "b").join(pick(after, "a"), F.col("b_id") == F.col("a_id"), "full")
    here, there = F.col("b_id").isNotNull(), F.col("a_id").isNotNull()
    differ = ~F.col("a").eqNullSafe(F.col("b")) if same or sorted(visible(before)) == sorted(visible(after)) else F.lit(True)
    count = lambda mask: F.coalesce(F.sum(mask.cast("long")), F.lit(0))
    return joined.agg(
        count(here).alias("rows_before"),
        count(there).alias("rows_after"),
        count(here & there & differ).alias("rows_changed"),
        count(there & ~here).alias("rows_added"),
        count(here & ~there).alias("rows_removed"),
    )


def totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, before, after: sums of the numeric columns that both tables have."""
    names = [c for c in visible(before) if c in after.columns and is_numeric(kind(before, c)) and is_numeric(kind(after, c))]

    def long(df: DataFrame, mark: str) -> DataFrame:
        sums = df.agg(F.lit(0).alias("z"), *[F.coalesce(F.sum(num(df, c)), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(names)])
        rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias(mark)) for i, c in enumerate(names)]
        return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*") if rows else df.sparkSession.createDataFrame([], f"column string, {mark} double")

    return long(before, "before").join(long(after, "after"), "column")
