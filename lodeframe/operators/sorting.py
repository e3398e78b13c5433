"""rows.sort: a stable sort by several keys."""

from __future__ import annotations

from pydantic import Field
from pyspark.sql import DataFrame

from ..functions.core import HIDDEN, ORDER, ORIGINAL_ORDER, ROW_ID, EngineError, position, qcol, require_columns
from ..plans.identity import dense, numbered
from .base import OpResult, Params, operator


BEFORE = HIDDEN + "before"


class SortKey(Params):
    column: str
    descending: bool = False
    nulls_last: bool = True


class SortRows(Params):
    keys: list[SortKey] = Field(min_length=1)
    preserve_original_order_metadata: bool = False


@operator("rows.sort", SortRows)
def sort_rows(df: DataFrame, p: SortRows) -> OpResult:
    """Sorts rows by keys; equal rows keep their order."""
    require_columns(df, [k.column for k in p.keys])
    if p.preserve_original_order_metadata:
        if ORIGINAL_ORDER in df.columns:
            raise EngineError("the original order is recorded already")
        df = numbered(df, ORIGINAL_ORDER)
        df = df.select(ORIGINAL_ORDER, *[qcol(c) for c in df.columns if c != ORIGINAL_ORDER])
    order = []
    for k in p.keys:
        c = qcol(k.column)
        if k.descending:
            order.append(c.desc_nulls_last() if k.nulls_last else c.desc_nulls_first())
        else:
            order.append(c.asc_nulls_last() if k.nulls_last else c.asc_nulls_first())
    if ROW_ID not in df.columns:
        return OpResult(df.orderBy(*order))
    before = df.withColumn(BEFORE, position(df)).drop(ORDER)
    return OpResult(dense(before, ORDER, [*order, qcol(BEFORE)]).drop(BEFORE))
