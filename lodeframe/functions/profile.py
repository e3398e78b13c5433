"""Profiles of tables: figures about columns, never their contents."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..operators.standardise import EMAIL
from .cells import cell_text, different
from .core import blank, kind, qcol, ustrip, visible
from .scalars import starts_formula

PHONE_HEADER = re.compile(r"phone|mobile|telephone|contact", re.IGNORECASE)
DATE_HEADER = re.compile(r"date|dob|birth", re.IGNORECASE)
# Date patterns besides ISO.
DATES = ("d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d")


def logical_type(df: DataFrame, name: str) -> Column:
    """What a value that isn't blank is."""
    t = kind(df, name)
    if isinstance(t, T.StringType):
        number = r"^[+-]?(?:[0-9]+|[0-9]+\.[0-9]*|[0-9]*\.[0-9]+)$"
        return F.when(ustrip(qcol(name)).rlike(number), "numeric_text").otherwise("text")
    for types, label in (
        ((T.BooleanType,), "boolean"),
        ((T.IntegralType,), "integer"),
        ((T.NumericType,), "number"),
        ((T.TimestampType, T.TimestampNTZType), "datetime"),
        ((T.DateType,), "date"),
    ):
        if isinstance(t, types):
            return F.lit(label)
    return F.lit(t.simpleString())


def parses_as_date(df: DataFrame, name: str) -> Column:
    if not isinstance(kind(df, name), T.StringType):
        return F.lit(isinstance(kind(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType)))
    text = ustrip(qcol(name))
    iso = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ].*)?$"), F.substring(text, 1, 10).try_cast("date"))
    return F.coalesce(iso, *[F.when(text.rlike(r"[0-9]{4}"), F.try_to_date(text, p)) for p in DATES]).isNotNull()


def column_figures(df: DataFrame, name: str) -> dict[str, Column]:
    c = qcol(name)
    text = c.cast("string")
    filled = ~blank(c)
    share = lambda mask: F.coalesce(F.sum((filled & mask).cast("long")), F.lit(0))
    is_text = isinstance(kind(df, name), T.StringType)
    types = F.array_sort(F.collect_set(F.when(filled, logical_type(df, name))))
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    return {
        "inferred_types": F.array_join(types, ","),
        "mixed_types": F.size(types) > 1,
        "blank_percentage": F.coalesce(F.round(100.0 * F.avg(blank(c).cast("double")), 2), F.lit(0.0)),
        "filled": F.coalesce(F.sum(filled.cast("long")), F.lit(0)),
        "formula_injection_count": share(starts_formula(text)) if is_text else F.lit(0).cast("long"),
        "suspicious_email_count": share(text.contains("@") & ~ustrip(text).rlike(EMAIL)) if is_text else F.lit(0).cast("long"),
        "suspicious_phone_count": share(~digits.between(10, 15)) if PHONE_HEADER.search(name) else F.lit(0).cast("long"),
        "invalid_date_count": share(~parses_as_date(df, name)) if DATE_HEADER.search(name) else F.lit(0).cast("long"),
    }


def unique_counts(df: DataFrame) -> dict[str, int]:
    """Different values of each column that aren't blank."""
    return different(df, {n: F.when(~blank(qcol(n)), cell_text(df, n)) for n in visible(df)})


def profile_columns(df: DataFrame) -> DataFrame:
    """A row for each column, from one aggregate over the table and two over its cells: of different values, and of the
    spellings of text columns with few of them."""
    names = visible(df)
    figures = [column_figures(df, n) for n in names]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[x.alias(f"c{i}_{k}") for i, f in enumerate(figures) for k, x in f.items()])
    texts = [n for n in names if isinstance(kind(df, n), T.StringType)]
    uniques = unique_counts(df)
    spelled = variations(df, texts)
    known = lambda n: [F.lit(x).cast("long") for x in (uniques[n], *spelled.get(n, (0, 0)))]
    more = ("unique_count", "inconsistent_category_count", "possible_spelling_variation_count")
    rows = [
        F.struct(
            F.lit(n).alias("name"),
            "rows",
            *[F.col(f"c{i}_{k}").alias(k) for k in figures[i]],
            *[x.alias(k) for k, x in zip(more, known(n), strict=True)],
        )
        for i, n in enumerate(names)
    ]
    each = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    key = (F.col("rows") > 0) & (F.col("filled") == F.col("rows")) & (F.col("unique_count") == F.col("rows"))
    return each.withColumn("candidate_key", key).drop("rows", "filled")


def profile_rows(df: DataFrame) -> DataFrame:
    """One row: data_rows, blank_rows, and duplicate_rows among those that aren't blank."""
    names = visible(df)
    empty = F.lit(True)
    for n in names:
        empty = empty & blank(qcol(n))
    whole = F.struct(*[qcol(n).cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    groups = df.groupBy(whole.alias("row"), empty.alias("empty")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("data_rows"),
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("blank_rows"),
        F.coalesce(F.sum(F.when(~F.col("empty"), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


@pandas_udf(T.StringType())
def category_key(values: pd.Series) -> pd.Series:
    return values.map(lambda x: " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


@pandas_udf(T.StringType())
def spelling_key(values: pd.Series) -> pd.Series:
    return values.map(lambda x: "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if c.isalnum()))


def variations(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """For each text column, how many different values differ in case or spaces only, and in punctuation too. Columns with
    many different values, against the square root of their rows, have none.

    Whatever the columns, their rows and their values are counted in a job each, and the spellings of those with few
    in a third.
    """
    stripped = {n: F.nullif(ustrip(qcol(n).cast("string")), F.lit("")) for n in names}
    rows = df.agg(F.lit(0), *[F.count(x) for x in stripped.values()]).first()[1:]
    most = {n: max(50, int(r**0.5) + 5) for n, r in zip(names, rows, strict=True) if r > 1}
    few = different(df, {n: stripped[n] for n in most})
    open_ = [n for n in most if few[n] <= most[n]]
    if not open_:
        return {n: (0, 0) for n in names}
    cells = F.array(*[F.struct(F.lit(n).alias("name"), stripped[n].alias("t")) for n in open_])
    own = df.select(F.explode(cells).alias("c")).select("c.*").where("t IS NOT NULL").distinct()
    keys = F.array(*[F.struct(F.lit(k).alias("which"), f("t").alias("key")) for k, f in enumerate((category_key, spelling_key))])
    sizes = own.select("name", F.explode(keys).alias("k")).groupBy("name", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sums = {(r["name"], r["which"]): r["n"] for r in sizes.groupBy("name", "k.which").agg(F.sum("n").alias("n")).collect()}
    return {n: (sums.get((n, 0), 0), sums.get((n, 1), 0)) for n in names}


def headers(raw: list[str | None], width: int | None = None) -> tuple[list[str], list[str]]:
    """Names for a header row, and those that occur more than once whatever their case."""
    names = [(h or "").strip() for h in raw] + [""] * max(0, (width or 0) - len(raw))
    names = [n or f"Column_{i + 1}" for i, n in enumerate(names)]
    folded = [n.casefold() for n in names]
    return names, [n for n, f in zip(names, folded) if folded.count(f) > 1]


# Severities in rising order.
SEVERITIES = ("info", "warning", "high", "blocking")


def table_warnings(columns: list[dict], rows: dict, duplicate_headers: list[str]) -> list[tuple[str, str]]:
    """(code, severity) for what a profile shows."""
    found = []
    for code, severity, holds in (
        ("duplicate_headers", "high", bool(duplicate_headers)),
        ("blank_rows", "info", rows["blank_rows"] > 0),
        ("duplicate_rows", "warning", rows["duplicate_rows"] > 0),
        ("mixed_types", "warning", any(c["mixed_types"] for c in columns)),
        ("formula_injection", "high", any(c["formula_injection_count"] for c in columns)),
        ("suspicious_emails", "warning", any(c["suspicious_email_count"] for c in columns)),
        ("suspicious_phones", "warning", any(c["suspicious_phone_count"] for c in columns)),
        ("invalid_dates", "warning", any(c["invalid_date_count"] for c in columns)),
        (
            "category_variations",
            "info",
            any(c["inconsistent_category_count"] + c["possible_spelling_variation_count"] for c in columns),
        ),
    ):
        if holds:
            found.append((code, severity))
    return found


def risk(found: list[tuple[str, str]]) -> str:
    return max((s for _, s in found), key=SEVERITIES.index, default="info")
