"""rows.filter, and the conditions that it shares with classification."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from typing import Annotated, Literal

from pydantic import Field, model_validator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import EngineError, as_date, blank, comparable, kind, member, num, qcol, require_columns, two_valued
from .base import Counts, OpResult, Params, operator

Scalar = bool | int | float | date | datetime | str | None


class Exact(Params):
    kind: Literal["exact"]
    column: str
    value: Scalar


class Text(Params):
    kind: Literal["contains", "starts_with", "ends_with"]
    column: str
    value: str
    case_sensitive: bool = False


class Numeric(Params):
    kind: Literal["numeric"]
    column: str
    operator: Literal["eq", "ne", "gt", "ge", "lt", "le"]
    value: float


class DateRange(Params):
    kind: Literal["date_range"]
    column: str
    start: date | None = None
    end: date | None = None

    @model_validator(mode="after")
    def in_order(self):
        if self.start and self.end and self.start > self.end:
            raise ValueError("start must not be after end")
        return self


class Blank(Params):
    kind: Literal["blank"]
    column: str
    is_blank: bool = True


class Listed(Params):
    kind: Literal["include_values", "exclude_values"]
    column: str
    values: list[Scalar] = Field(min_length=1)


Condition = Annotated[Exact | Text | Numeric | DateRange | Blank | Listed, Field(discriminator="kind")]


class FilterRows(Params):
    conditions: list[Condition] = Field(min_length=1)
    match: Literal["all", "any"] = "all"
    keep_matching: bool = True


COMPARE = {
    "eq": Column.__eq__,
    "ne": Column.__ne__,
    "gt": Column.__gt__,
    "ge": Column.__ge__,
    "lt": Column.__lt__,
    "le": Column.__le__,
}


def condition(df: DataFrame, x) -> Column:
    """A condition as a column that is true or false, never null."""
    require_columns(df, [x.column])
    c = qcol(x.column)
    if isinstance(x, Exact):
        if x.value is None:
            return c.isNull()
        if not comparable(kind(df, x.column), x.value):
            raise EngineError(f"the value for {x.column!r} has another type than the column")
        return two_valued(c == F.lit(x.value))
    if isinstance(x, Text):
        text, value = c.cast("string"), x.value
        if not x.case_sensitive:
            text, value = F.lower(text), value.lower()
        found = {"contains": text.contains, "starts_with": text.startswith, "ends_with": text.endswith}
        return two_valued(found[x.kind](value))
    if isinstance(x, Numeric):
        return two_valued(COMPARE[x.operator](num(df, x.column), F.lit(x.value)))
    if isinstance(x, DateRange):
        day = as_date(df, x.column)
        inside = day.isNotNull()
        if x.start:
            inside = inside & (day >= F.lit(x.start))
        if x.end:
            inside = inside & (day <= F.lit(x.end))
        return two_valued(inside)
    if isinstance(x, Blank):
        return blank(c) if x.is_blank else ~blank(c)
    found = member(df, x.column, x.values)
    return found if x.kind == "include_values" else ~found


def combined(df: DataFrame, conditions: list, match: str) -> Column:
    join = Column.__and__ if match == "all" else Column.__or__
    return reduce(join, [condition(df, x) for x in conditions])


@operator("rows.filter", FilterRows, destructive=lambda p: True)
def filter_rows(df: DataFrame, p: FilterRows) -> OpResult:
    """Keeps or removes the rows that match conditions."""
    mask = combined(df, p.conditions, p.match)
    mask = mask if p.keep_matching else ~mask
    kept = F.sum(mask.cast("long"))
    counts = Counts(
        df, {"input_rows": F.count(F.lit(1)), "output_rows": kept, "removed_rows": F.count(F.lit(1)) - F.coalesce(kept, F.lit(0))}
    )
    return OpResult(df.where(mask), counts=counts)
