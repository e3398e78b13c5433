"""values.standardize: brings the values of a column to one spelling."""

from __future__ import annotations

from typing import Literal

from pydantic import Field, model_validator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import EngineError, blank, casefolded, collapse, literal_map, num, pystr, qcol, require_columns, ustrip, with_columns
from .base import Counts, OpResult, Params, operator

# States and union territories, and former names of some.
STATES = """Andhra Pradesh; Arunachal Pradesh; Assam; Bihar; Chhattisgarh; Goa; Gujarat; Haryana; Himachal Pradesh;
Jharkhand; Karnataka; Kerala; Madhya Pradesh; Maharashtra; Manipur; Meghalaya; Mizoram; Nagaland; Odisha; Punjab;
Rajasthan; Sikkim; Tamil Nadu; Telangana; Tripura; Uttar Pradesh; Uttarakhand; West Bengal;
Andaman and Nicobar Islands; Chandigarh; Dadra and Nagar Haveli and Daman and Diu; Delhi; Jammu and Kashmir; Ladakh;
Lakshadweep; Puducherry"""
FORMER_NAMES = {
    "orissa": "Odisha",
    "uttaranchal": "Uttarakhand",
    "pondicherry": "Puducherry",
    "nct of delhi": "Delhi",
    "new delhi": "Delhi",
}
EMAIL = r"(?i)^[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\z"
# Date directives and the patterns that read and write them.
READ = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%b": "MMM", "%B": "MMMM", "%y": "yy"}
WRITE = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "DDD"}


class Standardize(Params):
    column: str
    mode: Literal["state", "district", "status_category", "telephone", "email", "date", "numeric_text"]
    mapping: dict[str, str] = Field(default_factory=dict)
    default_country_code: str | None = Field(default=None, pattern=r"^\d{1,4}$")
    input_date_formats: list[str] = Field(
        default_factory=lambda: ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"], min_length=1
    )
    output_date_format: str = Field(default="%Y-%m-%d", min_length=2, max_length=40)
    invalid_policy: Literal["leave", "null", "reject"] = "leave"
    numeric_target: Literal["number", "integer"] = "number"

    @model_validator(mode="after")
    def with_mapping(self):
        if self.mode in ("district", "status_category") and not self.mapping:
            raise ValueError(f"{self.mode} needs a mapping")
        return self


def pattern_of(directives: str, table: dict[str, str]) -> str:
    """A strftime format as a pattern of Spark's."""
    out, i = "", 0
    while i < len(directives):
        two = directives[i : i + 2]
        if two in table:
            out += table[two]
            i += 2
        elif two == "%%":
            out += "%"
            i += 2
        elif two[:1] == "%":
            raise EngineError(f"date directive {two} isn't supported")
        else:
            out += f"'{two[0]}'" if two[0].isalpha() else "''" if two[0] == "'" else two[0]
            i += 1
    return out


def key_of(c: Column) -> Column:
    return ustrip(collapse(casefolded(c)))


def plain_key(text: str) -> str:
    return " ".join(text.casefold().split())


def _converted(p: Standardize, c: Column) -> Column:
    """The standard spelling of a text, or null if it has none."""
    if p.mode in ("state", "district", "status_category"):
        known = {plain_key(k): v for k, v in p.mapping.items()}
        if p.mode == "state":
            own = {plain_key(s): " ".join(s.split()) for s in STATES.split(";")}
            known = own | FORMER_NAMES | known
        return literal_map(known, key_of(c))
    if p.mode == "telephone":
        digits = F.regexp_replace(c, r"\D", "")
        plain = F.when(ustrip(c).startswith("+"), F.concat(F.lit("+"), digits))
        if p.default_country_code:
            plain = plain.when(F.length(digits) == 10, F.concat(F.lit("+" + p.default_country_code), digits))
        return F.when(F.length(digits).between(10, 15), plain.otherwise(digits))
    if p.mode == "email":
        address = F.lower(ustrip(c))
        return F.when(address.rlike(EMAIL), address)
    text = ustrip(c)
    tried = []
    for directives in p.input_date_formats:
        pattern = pattern_of(directives, READ)
        four = F.lit(True) if "yyyy" not in pattern else text.rlike(r"(?<![0-9])[0-9]{4}(?![0-9])")
        tried.append(F.when(four, F.try_to_date(text, pattern)))
    tried.append(F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.substring(text, 1, 10).try_cast("date")))
    return F.date_format(F.coalesce(*tried), pattern_of(p.output_date_format, WRITE))


def _numeric(df: DataFrame, p: Standardize) -> OpResult:
    value = num(df, p.column)
    invalid = qcol(p.column).isNotNull() & value.isNull()
    fraction = value != F.floor(value)
    counts = Counts(df, {"invalid_values": F.sum(invalid.cast("long")), "fractions": F.sum(fraction.cast("long"))})
    if p.invalid_policy != "null" and counts["invalid_values"]:
        raise EngineError(f"{counts['invalid_values']} value(s) of {p.column!r} are not numeric")
    if p.numeric_target == "integer" and counts["fractions"]:
        raise EngineError(f"{counts['fractions']} value(s) of {p.column!r} are not whole")
    out = value.cast("bigint") if p.numeric_target == "integer" else value
    return OpResult(with_columns(df, {p.column: out}), counts=counts)


@operator("values.standardize", Standardize, destructive=lambda p: p.invalid_policy == "null")
def standardize(df: DataFrame, p: Standardize) -> OpResult:
    """Brings the values of a column to one spelling; blank values stay as they are."""
    require_columns(df, [p.column])
    if p.mode == "numeric_text":
        return _numeric(df, p)
    text = pystr(df, p.column)
    found = _converted(p, text)
    bad = ~blank(text) & found.isNull()
    rest = F.lit(None).cast("string") if p.invalid_policy == "null" else text
    new = F.when(blank(text), text).otherwise(F.coalesce(found, rest))
    counts = Counts(df, {"uncertain_values": F.sum(bad.cast("long"))})
    if p.invalid_policy == "reject" and counts["uncertain_values"]:
        raise EngineError(f"{counts['uncertain_values']} value(s) of {p.column!r} can't be standardized")
    warn = lambda c: f"{c['uncertain_values']} value(s) could not be standardized" if c["uncertain_values"] else None
    return OpResult(with_columns(df, {p.column: new}), counts=counts, warnings=[warn])
