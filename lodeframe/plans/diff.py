"""Differences between two states of a table, by row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import HIDDEN, ROW_ID, qcol, visible
from ..functions.stored import bucketed
from .identity import numbered

#: Kinds of changes in their order.
KINDS = ("row_deleted", "row_added", "cell_changed", "row_reordered", "column_deleted", "column_added")
CHANGE = "struct<kind:string,column:string,old:string,new:string>"

#: A row's rank in its table, where that is known.
PLACE = HIDDEN + "place"


def side(df: DataFrame) -> DataFrame:
    """A table with its rows' ranks, stored in buckets of the row ids, to be compared with other states of it."""
    return bucketed(numbered(df, PLACE), "state", ROW_ID)


def _text(c: Column) -> Column:
    return c.cast("string")


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[_text(qcol(c)).alias(c) for c in visible(df)]))


def _change(kind: str, column=None, old=None, new=None) -> Column:
    part = lambda x: F.lit(None).cast("string") if x is None else x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("kind"), part(column).alias("column"), part(old).alias("old"), part(new).alias("new")
    ).cast(CHANGE)


def _differs(a: Column, b: Column, ta, tb) -> Column:
    if ta != tb:
        return ~_text(a).eqNullSafe(_text(b))
    return ~a.eqNullSafe(b)  # NaN equals NaN


def changes(before: DataFrame, after: DataFrame, reordered: bool = True) -> DataFrame:
    """row_id, kind, column, old, new and change_id: what differs, cell by cell. Both tables carry row ids.

    One full join by row id; a row that is on both sides unfolds into its changes. With ``reordered``, positions are
    compared too, so that a deletion counts as a move of all rows below it. Sides that side() has stored are joined without a
    shuffle.
    """
    common = [c for c in visible(before) if c in after.columns]
    gone = [c for c in visible(before) if c not in after.columns]
    new = [c for c in visible(after) if c not in before.columns]
    if reordered:
        before, after = (df if PLACE in df.columns else numbered(df, PLACE) for df in (before, after))
    side = lambda df, mark: df.select(
        qcol(ROW_ID).alias(f"{mark}_id"),
        *[qcol(c).alias(f"{mark}_{i}") for i, c in enumerate(visible(df))],
        _row(df).alias(f"{mark}_row"),
        *([F.col(PLACE).alias(f"{mark}_place")] if reordered else []),
    )
    index = lambda df, c: visible(df).index(c)
    joined = side(before, "b").join(side(after, "a"), F.col("b_id") == F.col("a_id"), "full")
    cells = []
    for c in sorted(common):
        b, a = F.col(f"b_{index(before, c)}"), F.col(f"a_{index(after, c)}")
        differ = _differs(b, a, before.schema[c].dataType, after.schema[c].dataType)
        cells.append(F.when(differ, _change("cell_changed", c, _text(b), _text(a))))
    if reordered:
        moved = F.col("b_place") != F.col("a_place")
        cells.append(F.when(moved, _change("row_reordered", None, _text(F.col("b_place")), _text(F.col("a_place")))))
    cells += [_change("column_deleted", c, _text(F.col(f"b_{index(before, c)}"))) for c in sorted(gone)]
    cells += [_change("column_added", c, None, _text(F.col(f"a_{index(after, c)}"))) for c in sorted(new)]
    both = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast(f"array<{CHANGE}>")
    each = (
        F.when(F.col("a_id").isNull(), F.array(_change("row_deleted", None, F.col("b_row"))))
        .when(F.col("b_id").isNull(), F.array(_change("row_added", None, None, F.col("a_row"))))
        .otherwise(both)
    )
    rows = joined.select(F.coalesce("b_id", "a_id").alias("row_id"), F.explode(each).alias("x")).select("row_id", "x.*")
    told = F.to_json(F.struct("row_id", "kind", "column", "old", "new"), {"ignoreNullFields": "false"})
    return rows.withColumn("change_id", F.sha2(told.cast("binary"), 256))


def sample(found: DataFrame, limit: int = 10_000) -> DataFrame:
    """The first changes: deleted and added rows, then row by row; the limit is the preview's."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    first = F.least(rank, F.lit(3))
    return found.orderBy(first, "row_id", rank, "column").limit(limit)


def search(found: DataFrame, category: str = "all", text: str = "") -> DataFrame:
    """Changes of a category (all, changed, deleted) in which a text occurs, whatever its case."""
    if category == "changed":
        found = found.where(F.col("kind") == "cell_changed")
    elif category == "deleted":
        found = found.where(F.col("kind").isin("row_deleted", "column_deleted"))
    if text:
        held = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in ("row_id", "kind", "column", "old", "new")]))
        found = found.where(held.contains(text.lower()))
    return found
