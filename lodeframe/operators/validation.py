"""quality.validate: rules that data has to meet. All rules of a table are counted in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Annotated, Any, Literal

from pydantic import Field, TypeAdapter, model_validator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import ORDER, ROW_ID, as_date, blank, member, num, pystr, qcol, require_columns, ustrip, visible
from ..plans.identity import identified, numbered
from .base import Counts, OpResult, Params, operator
from .grouping import with_figures
from .standardise import EMAIL

Scalar = bool | int | float | str | None
# What spreadsheets show for errors.
FORMULA_ERRORS = ["#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"]
#: Row numbers that an issue names at most.
NAMED_ROWS = 1_000


class _Bounded(Params):
    @model_validator(mode="after")
    def in_order(self):
        low = getattr(self, "minimum", getattr(self, "min_digits", None))
        high = getattr(self, "maximum", getattr(self, "max_digits", None))
        if low is not None and high is not None and low > high:
            raise ValueError("the minimum is above the maximum")
        return self


class RequiredFields(Params):
    kind: Literal["required_fields"]
    columns: list[str] = Field(min_length=1)


class Telephone(_Bounded):
    kind: Literal["telephone"]
    column: str
    min_digits: int = Field(default=10, ge=1, le=20)
    max_digits: int = Field(default=15, ge=1, le=20)


class Email(Params):
    kind: Literal["email"]
    column: str


class DateRange(_Bounded):
    kind: Literal["date_range"]
    column: str
    minimum: date | None = None
    maximum: date | None = None


class NumericRange(_Bounded):
    kind: Literal["numeric_range"]
    column: str
    minimum: float | None = None
    maximum: float | None = None


class AllowedValues(Params):
    kind: Literal["allowed_values"]
    column: str
    values: list[Scalar] = Field(min_length=1)


class DuplicateId(Params):
    kind: Literal["duplicate_id"]
    columns: list[str] = Field(min_length=1)


class MissingLookup(Params):
    kind: Literal["missing_lookup"]
    column: str
    allowed_keys: list[Scalar] = Field(min_length=1)


class RowCount(Params):
    kind: Literal["row_count"]
    expected: int = Field(ge=0)


class Total(Params):
    kind: Literal["total"]
    column: str
    expected: float
    tolerance: float = Field(default=0.001, ge=0)


class FormulaErrors(Params):
    kind: Literal["formula_errors"]
    columns: list[str] = Field(default_factory=list)


class BlankRows(Params):
    kind: Literal["blank_rows"]


class InvalidHeaders(Params):
    kind: Literal["invalid_headers"]


Rule = Annotated[
    RequiredFields | Telephone | Email | DateRange | NumericRange | AllowedValues | DuplicateId | MissingLookup | RowCount
    | Total | FormulaErrors | BlankRows | InvalidHeaders,
    Field(discriminator="kind"),
]
RULE = TypeAdapter(Rule)


class Validate(Params):
    rules: list[Rule] = Field(min_length=1)


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    column: str | None
    affected_rows: int
    rows: tuple[int, ...] = ()
    severity: str = "error"


@dataclass(frozen=True)
class Report:
    checks_run: int
    issues: tuple[Issue, ...]

    @property
    def passed(self) -> bool:
        return not any(i.severity == "error" for i in self.issues)


def size_of(r: DuplicateId) -> str:
    """The column that holds how many rows share a row's key; validate_table() adds it."""
    return "__lf_size_" + "_".join(r.columns)


def bad_rows(df: DataFrame, r: Any) -> list[tuple[str, str, str | None, Column]]:
    """(code, message, column, whether a row breaks the rule) for each check of a rule on rows."""
    if isinstance(r, RequiredFields):
        require_columns(df, r.columns)
        return [("missing_required", f"{c} is required", c, blank(qcol(c))) for c in r.columns]
    if isinstance(r, DuplicateId):
        require_columns(df, r.columns)
        return [("duplicate_id", "keys occur more than once", ", ".join(r.columns), qcol(size_of(r)) > 1)]
    if isinstance(r, FormulaErrors):
        names = r.columns or visible(df)
        require_columns(df, names)
        bad = F.lit(False)
        for c in names:
            bad = bad | F.coalesce(qcol(c).cast("string").isin(FORMULA_ERRORS), F.lit(False))
        return [("formula_error", "cells hold spreadsheet errors", None, bad)]
    if isinstance(r, BlankRows):
        bad = F.lit(True)
        for c in visible(df):
            bad = bad & blank(qcol(c))
        return [("blank_row", "rows are blank", None, bad)]
    require_columns(df, [r.column])
    c = qcol(r.column)
    if isinstance(r, Telephone):
        digits = F.length(F.regexp_replace(pystr(df, r.column, ""), r"\D", ""))
        return [("invalid_telephone", "not a telephone number", r.column, ~blank(c) & ~digits.between(r.min_digits, r.max_digits))]
    if isinstance(r, Email):
        fits = ustrip(pystr(df, r.column, "")).rlike(EMAIL)
        return [("invalid_email", "not an e-mail address", r.column, ~blank(c) & ~fits)]
    if isinstance(r, (DateRange, NumericRange)):
        dates = isinstance(r, DateRange)
        value = as_date(df, r.column) if dates else num(df, r.column)
        fits = value.isNotNull()
        if r.minimum is not None:
            fits = fits & (value >= F.lit(r.minimum))
        if r.maximum is not None:
            fits = fits & (value <= F.lit(r.maximum))
        bad = ~F.coalesce(fits, F.lit(False))
        if dates:
            return [("invalid_date_range", "not a date in range", r.column, bad)]
        return [("invalid_numeric_range", "not a number in range", r.column, c.isNotNull() & bad)]
    if isinstance(r, AllowedValues):
        return [("value_not_allowed", "value is not allowed", r.column, ~member(df, r.column, r.values))]
    return [("missing_lookup", "key is not known", r.column, ~member(df, r.column, r.allowed_keys))]


def validate_table(df: DataFrame, rules: list, original_headers: list[str] | None = None, rows: bool = True) -> Report:
    """Checks a table. Counts take one aggregate; the rows of broken rules take one more."""
    checks: list[tuple[str, str, str | None, Column]] = []
    totals: list[tuple[Any, Column]] = []
    issues: list[Issue] = []
    for r in rules:
        if isinstance(r, RowCount):
            totals.append((r, F.count(F.lit(1))))
        elif isinstance(r, Total):
            require_columns(df, [r.column])
            totals.append((r, F.coalesce(F.sum(num(df, r.column)), F.lit(0.0))))
        elif not isinstance(r, InvalidHeaders):
            checks += bad_rows(df, r)
    if rows and checks and ROW_ID not in df.columns:
        df = identified(df)
    sized = df
    for r in rules:
        if isinstance(r, DuplicateId) and size_of(r) not in sized.columns:
            sized = with_figures(sized, [qcol(c) for c in r.columns], {size_of(r): F.count(F.lit(1))})
    marked = sized.select(*[qcol(c) for c in (*visible(df), ROW_ID, ORDER) if c in df.columns], *[x[3].alias(f"__lf_bad{i}") for i, x in enumerate(checks)])
    sums = [F.coalesce(F.sum(F.col(f"__lf_bad{i}").cast("long")), F.lit(0)) for i in range(len(checks))]
    found = marked.agg(F.lit(0), *sums, *[x for _, x in totals]).first()[1:] if sums or totals else []
    flags = [c for c in marked.columns if c in (ROW_ID, ORDER) or c.startswith("__lf_bad")]
    place = numbered(marked.select(*flags), "__lf_line", start=2) if rows and any(found[: len(checks)]) else None
    named: dict[int, list[int]] = {}
    if place is not None:
        broken = F.filter(F.array(*[F.when(F.col(f"__lf_bad{i}"), i) for i in range(len(checks))]), lambda i: i.isNotNull())
        first = F.row_number().over(Window.partitionBy("i").orderBy("__lf_line"))  # cut off in each task before the shuffle
        lines = place.select("__lf_line", F.explode(broken).alias("i")).withColumn("n", first).where(F.col("n") <= NAMED_ROWS)
        for row in lines.collect():
            named.setdefault(row["i"], []).append(row["__lf_line"])
    for i, (code, message, column, _) in enumerate(checks):
        if found[i]:
            issues.append(Issue(code, message, column, found[i], tuple(sorted(named.get(i, ())))))
    for (r, _), value in zip(totals, found[len(checks) :]):
        if isinstance(r, RowCount) and value != r.expected:
            issues.append(Issue("row_count_mismatch", f"{value} rows instead of {r.expected}", None, abs(value - r.expected)))
        elif isinstance(r, Total) and abs(value - r.expected) > r.tolerance:
            issues.append(Issue("total_mismatch", f"a total of {value} instead of {r.expected}", r.column, 0))
    if any(isinstance(r, InvalidHeaders) for r in rules):
        headers = visible(df) if original_headers is None else original_headers
        folded = [h.strip().casefold() for h in headers]
        bad = [h for h, f in zip(headers, folded) if not f or folded.count(f) > 1]
        if bad:
            issues.append(Issue("invalid_headers", "headers are blank or repeated", None, len(bad)))
    return Report(len(rules), tuple(issues))


@operator("quality.validate", Validate)
def validate(df: DataFrame, p: Validate) -> OpResult:
    """Checks a table against rules and lists what breaks them as a further table; the table itself stays."""
    report = validate_table(df, p.rules)
    lines = [(i.code, i.severity, i.column, i.affected_rows) for i in report.issues]
    table = df.sparkSession.createDataFrame(lines, "Code string, Severity string, Column string, `Affected Rows` long")
    counts = Counts(known={"checks_run": report.checks_run, "issues": len(lines)})
    return OpResult(df, aux={"Validation Issues": table}, counts=counts, warnings=[i.message for i in report.issues], report=report)
