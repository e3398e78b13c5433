"""The semantic core: expressions that never fail on a bad cell and treat null, blank and types as the plans expect."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Sequence
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Columns whose names start so are the engine's own: they are neither exported nor compared, and plans can't name them.
HIDDEN = "__lf_"
ROW_ID = HIDDEN + "row"
#: Position, where a sort has changed the order of the row ids.
ORDER = HIDDEN + "order"
ORIGINAL_ORDER = HIDDEN + "original_order"
#: White space as str.isspace() has it, for a character class.
WHITE = r"\s\x1c-\x1f"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


class EngineError(ValueError):
    """A plan or its data can't be processed as asked."""


def qcol(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_hidden(name: str) -> bool:
    return name.casefold().startswith(HIDDEN)


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not is_hidden(c)]


def position(df: DataFrame) -> Column:
    """What a table's rows are ordered by."""
    return qcol(ORDER if ORDER in df.columns else ROW_ID)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Names are matched exactly, in contrast to Spark's own resolution."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise EngineError("unknown columns: " + ", ".join(missing))


def require_new(df: DataFrame, names: Iterable[str], replacing: Iterable[str] = ()) -> None:
    taken = {c.casefold() for c in df.columns if c not in set(replacing)}
    for n in names:
        if n.casefold() in taken:
            raise EngineError(f"column {n!r} exists already")
        taken.add(n.casefold())


def check_names(df: DataFrame) -> DataFrame:
    names = visible(df)
    if not names:
        raise EngineError("a table needs a column")
    for n in names:
        if not n.strip() or "\x00" in n or len(n) > 255:
            raise EngineError(f"column name {n!r} is not valid")
    if len({n.casefold() for n in names}) < len(names):
        raise EngineError("column names must differ in more than case")
    return df


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """New or replaced columns, by exact name; replaced ones keep their places."""
    kept = [new[c].alias(c) if c in new else qcol(c) for c in df.columns]
    return df.select(*kept, *[x.alias(c) for c, x in new.items() if c not in df.columns])


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.NullType))


def ustrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{WHITE}]+|[{WHITE}]+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)[{WHITE}]+", " ")


def blank(c: Column) -> Column:
    """Null, or nothing but white space as text. Never null."""
    return c.isNull() | (ustrip(c.cast("string")) == "")


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def num(df: DataFrame, name: str) -> Column:
    """The column as double; null where its text is no number."""
    c, t = qcol(name), kind(df, name)
    if isinstance(t, T.StringType):
        return F.when(c.rlike(NUMBER), c.try_cast("double"))
    if is_numeric(t) or isinstance(t, (T.BooleanType, T.NullType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def as_date(df: DataFrame, name: str, iso: bool = True) -> Column:
    """The column as date; null where its text is no ISO date, with or without a time."""
    c, t = qcol(name), kind(df, name)
    if isinstance(t, T.StringType):
        text = ustrip(c)
        shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?$"
        return F.when(text.rlike(shape), F.substring(text, 1, 10).try_cast("date"))
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    return F.lit(None).cast("date")


def literal(value) -> Column:
    return F.lit(value) if value is not None else F.lit(None).cast("string")


def comparable(t: T.DataType, value) -> bool:
    """Whether a plan's literal has the type of a column."""
    if value is None or isinstance(t, T.NullType):
        return True
    if isinstance(value, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(value, (int, float)):
        return is_numeric(t)
    if isinstance(value, (date, datetime)):
        return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return isinstance(t, T.StringType)


def member(df: DataFrame, name: str, values: Sequence) -> Column:
    """Null-safe membership: null is a member only if listed. Values of another type match nothing."""
    c, t = qcol(name), kind(df, name)
    own = [v for v in values if v is not None and comparable(t, v)]
    found = two_valued(c.isin(own)) if own and not isinstance(t, T.NullType) else F.lit(False)
    return found | c.isNull() if any(v is None for v in values) else found


@pandas_udf(T.StringType())
def _float_text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else repr(float(x)), na_action=None)


def pystr(df: DataFrame, name: str, null: str | None = None) -> Column:
    """The column as Python's str() writes it; null as ``null``."""
    c, t = qcol(name), kind(df, name)
    if isinstance(t, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    elif isinstance(t, (T.DoubleType, T.FloatType)):
        text = F.when(c.isNotNull(), _float_text(c.cast("double")))
    else:
        text = c.cast("string")
    return text if null is None else F.coalesce(text, F.lit(null))


def one_type(df: DataFrame, parts: list[tuple[Column, T.DataType | None]]) -> list[Column]:
    """Parts of a column brought to one type: all numbers to double (whole ones to long), else all to text."""
    types = [t for _, t in parts if t is not None and not isinstance(t, T.NullType)]
    if types and all(isinstance(t, (T.IntegralType,)) for t in types):
        target = "bigint"
    elif types and all(is_numeric(t) for t in types):
        target = "double"
    elif types and all(type(t) is type(types[0]) for t in types):
        target = types[0].simpleString()
    else:
        target = "string"
    return [c.cast(target) for c, _ in parts]


def literal_type(value) -> T.DataType | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    return T.DoubleType() if isinstance(value, float) else T.StringType()


@pandas_udf(T.StringType())
def casefolded(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else x.casefold(), na_action=None)


@pandas_udf(T.StringType())
def title_case(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else x.title(), na_action=None)


def normalized(form: str):
    @pandas_udf(T.StringType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize(form, x), na_action=None)

    return apply


@pandas_udf(T.StringType())
def json_list(values: pd.Series) -> pd.Series:
    """A JSON array of strings, as the standard library writes it compactly in ASCII."""
    return values.map(lambda x: json.dumps(list(x), ensure_ascii=True, separators=(",", ":")))


def literal_map(mapping: dict, key: Column, cast: str = "string") -> Column:
    """The mapped value or null; one literal map, so that any number of entries stays a constant."""
    if not mapping:
        return F.lit(None).cast(cast)
    pairs = F.map_from_arrays(F.lit(list(mapping)), F.array(*[literal(v).cast(cast) for v in mapping.values()]))
    return F.try_element_at(pairs, key)
