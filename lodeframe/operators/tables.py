"""tables.merge and table.split_by_category."""

from __future__ import annotations

import re
from functools import reduce
from typing import Literal

from pydantic import Field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import (
    ROW_ID,
    EngineError,
    blank,
    kind,
    one_type,
    position,
    pystr,
    qcol,
    require_columns,
    require_new,
    visible,
    with_columns,
)
from ..functions.stored import stored_parts
from .base import Counts, OpResult, Params, operator


class MergeTables(Params):
    table_names: list[str] = Field(default_factory=list)
    schema_mode: Literal["strict", "union"] = "strict"
    source_column: str | None = None


class SplitByCategory(Params):
    category_column: str
    table_prefix: str = ""
    include_blank: bool = True
    drop_category_column: bool = False
    max_tables: int = Field(default=200, gt=0, le=1000)


def safe_table_name(name: str, taken: set[str]) -> str:
    """At most 31 characters without []:*?/\\, unlike all in ``taken``, to which it is added."""
    base = re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", name).strip().strip("'")[:31] or "Sheet"
    out, n = base, 1
    while out.casefold() in taken:
        n += 1
        mark = f" ({n})"
        out = base[: 31 - len(mark)] + mark
    taken.add(out.casefold())
    return out


def united(tables: dict[str, DataFrame], mode: str, source_column: str | None = None) -> DataFrame:
    """All rows, table after table. Columns whose types differ become numbers if all are, else text."""
    frames = dict(tables)
    if source_column:
        for name, df in tables.items():
            require_new(df, [source_column])
            frames[name] = with_columns(df, {source_column: F.lit(name)})
    names: list[str] = []
    for df in frames.values():
        names += [c for c in df.columns if c not in names]
    if mode == "strict" and len({tuple(visible(df)) for df in frames.values()}) > 1:
        raise EngineError("a strict merge takes tables with the same columns in the same order")
    casts: dict[str, list] = {}
    for c in names:
        own = [df for df in frames.values() if c in df.columns]
        if mode == "strict" and len({kind(df, c) for df in own}) > 1:
            raise EngineError(f"a strict merge takes one type for {c!r}")
        casts[c] = one_type(own[0], [(qcol(c), kind(df, c)) for df in own]) if len({kind(df, c) for df in own}) > 1 else [qcol(c)] * len(own)
    parts = []
    for df in frames.values():
        columns = []
        for c in names:
            if c in df.columns:
                new = casts[c].pop(0)
                if "string" in str(new) and kind(df, c).simpleString() in ("double", "float", "boolean"):
                    new = pystr(df, c)
                columns.append(new.alias(c))
        parts.append(df.select(*columns))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@operator("tables.merge", MergeTables, many=True)
def merge_tables(tables: dict[str, DataFrame], p: MergeTables) -> OpResult:
    """Appends tables to one another, by name."""
    names = p.table_names or list(tables)
    missing = [n for n in names if n not in tables]
    if missing or not names:
        raise EngineError("unknown tables: " + ", ".join(missing))
    merged = united({n: tables[n] for n in names}, p.schema_mode, p.source_column)
    return OpResult(merged, counts=Counts(merged, {"merged_rows": F.count(F.lit(1))}, {"merged_tables": len(names)}))


@operator("table.split_by_category", SplitByCategory, destructive=lambda p: p.drop_category_column)
def split_by_category(df: DataFrame, p: SplitByCategory) -> OpResult:
    """A further table for each value of a column; the table itself stays. Only the values, of which there are max_tables
    at most, reach the driver; the table is read once to find them and once to write all parts."""
    require_columns(df, [p.category_column])
    c = qcol(p.category_column)
    at = position(df) if ROW_ID in df.columns else F.monotonically_increasing_id()
    found = df.select(c.alias("v"), at.alias("at")).groupBy("v").agg(F.min("at").alias("at"))
    found = found if p.include_blank else found.where(~blank(F.col("v")))
    values = [r["v"] for r in found.orderBy("at").limit(p.max_tables + 1).collect()]
    if len(values) > p.max_tables:
        raise EngineError(f"more than {p.max_tables} categories")
    aux: dict[str, DataFrame] = {}
    taken: set[str] = set()
    filled = [(i, v) for i, v in enumerate(values) if v is not None]
    schema = T.StructType([T.StructField("__lf_value", kind(df, p.category_column)), T.StructField("__lf_number", T.IntegerType())])
    numbers = F.broadcast(df.sparkSession.createDataFrame([(v, i) for i, v in filled], schema))
    numbered = df.join(numbers, c == F.col("__lf_value"), "left") if filled else df.withColumn("__lf_number", F.lit(None).cast("int"))
    number = F.when(c.isNull(), F.lit(values.index(None) if None in values else None)).otherwise(F.col("__lf_number")).cast("int")
    kept = [x for x in df.columns if not p.drop_category_column or x != p.category_column]
    parts = stored_parts(numbered.withColumn("__lf_number", number).select(*[qcol(x) for x in kept], "__lf_number"), "categories", F.col("__lf_number"), len(values))
    for v, part in zip(values, parts, strict=True):
        label = "Blank" if v is None or not str(v).strip() else str(v)
        aux[safe_table_name(p.table_prefix + label, taken)] = part.drop("__lf_number")
    return OpResult(df, aux=aux, counts=Counts(df, {"source_rows": F.count(F.lit(1))}, {"created_tables": len(aux)}))
