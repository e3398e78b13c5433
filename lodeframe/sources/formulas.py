"""Spreadsheet formulas for calculated columns, from a fixed set of templates."""

from __future__ import annotations

from datetime import date
from typing import Literal

from pydantic import Field, model_validator

from ..functions.core import EngineError
from ..operators.base import Params
from ..operators.calculations import Age, ChainedArithmetic, DateDifference, Gst, OrderedArithmetic, Percentage, QuantityPrice

TWO = ("subtraction", "division", "percentage", "quantity_price", "date_difference")
# What a spreadsheet computes, with {0}, {1} for the operands' cells.
TEMPLATES = {
    "subtraction": "{0}-{1}",
    "division": 'IFERROR({0}/{1},"")',
    "percentage": 'IFERROR({0}/{1}*100,"")',
    "quantity_price": "{0}*{1}",
    "date_difference": "{1}-{0}",
}


class FormulaSpec(Params):
    output_column: str
    kind: Literal["addition", "subtraction", "multiplication", "division", "percentage", "quantity_price", "gst", "date_difference", "age"]
    operand_columns: list[str] = Field(min_length=1)
    rate_percent: float | None = Field(default=None, ge=0, le=100)
    include_base: bool = False
    as_of: date | None = None
    number_format: str | None = Field(default=None, max_length=40)

    @model_validator(mode="after")
    def complete(self):
        n = len(self.operand_columns)
        if self.kind in TWO and n != 2:
            raise ValueError(f"{self.kind} takes two columns")
        if self.kind in ("gst", "age") and (n != 1 or (self.rate_percent if self.kind == "gst" else self.as_of) is None):
            raise ValueError(f"{self.kind} takes a column and a {'rate' if self.kind == 'gst' else 'date'}")
        return self


def letters(i: int) -> str:
    """The name of the column at index i."""
    out = ""
    while i >= 0:
        out = chr(65 + i % 26) + out
        i = i // 26 - 1
    return out


def formula(spec: FormulaSpec, headers: list[str], row: int) -> str:
    if spec.output_column in headers:
        raise EngineError(f"column {spec.output_column!r} exists already")
    missing = [c for c in spec.operand_columns if c not in headers]
    if missing:
        raise EngineError("unknown columns: " + ", ".join(missing))
    cells = [f"{letters(headers.index(c))}{row}" for c in spec.operand_columns]
    if spec.kind in TEMPLATES:
        text = TEMPLATES[spec.kind].format(*cells)
    elif spec.kind == "gst":
        text = f"{cells[0]}*{spec.rate_percent}/100"
        text = f"{cells[0]}+{text}" if spec.include_base else text
    elif spec.kind == "age":
        day = spec.as_of
        text = f'DATEDIF({cells[0]},DATE({day.year},{day.month},{day.day}),"Y")'
    else:
        text = ("+" if spec.kind == "addition" else "*").join(cells)
    return "=" + text


def spec_of(action) -> FormulaSpec | None:
    """The formula of a calculation, or None where a spreadsheet has none for it: calculations with constants, by whole
    months or years, and those over several rows."""
    common = {"output_column": action.output, "kind": action.kind}
    if isinstance(action, (ChainedArithmetic, OrderedArithmetic)):
        operands = [x.column for x in action.operands]
    elif isinstance(action, Percentage):
        operands = [action.numerator.column, action.denominator.column]
    elif isinstance(action, QuantityPrice):
        operands = [action.quantity_column, action.price_column]
    elif isinstance(action, Gst):
        operands, common = [action.base_column], common | {"rate_percent": action.rate_percent, "include_base": action.include_base}
    elif isinstance(action, DateDifference) and action.unit == "days":
        operands = [action.start_column, action.end_column]
    elif isinstance(action, Age):
        operands, common = [action.birth_date_column], common | {"as_of": action.as_of}
    else:
        return None
    return None if None in operands else FormulaSpec(operand_columns=operands, **common)
