"""Figures of all columns of a table from its cells, in a number of jobs that doesn't depend on the columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import kind, qcol


def cell_text(df: DataFrame, name: str) -> Column:
    """A cell as text, equal for equal values: -0.0 is 0.0."""
    c, t = qcol(name), kind(df, name)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return (c + 0.0).cast("string")
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(F.struct(c.alias("v")))
    return c.cast("string")


def different(df: DataFrame, values: Mapping[str, Column]) -> dict[str, int]:
    """How many different values that aren't null each text expression has.

    One aggregate over (expression, value) rows, combined in each task before the shuffle, in which long values go as digests;
    no row of the table is copied for each of its columns. A row for each expression meets on the driver.
    """
    if not values:
        return {}
    short = lambda v: F.when(F.length(v) > 64, F.sha2(v.cast("binary"), 256)).otherwise(v)
    cells = F.array(*[F.struct(F.lit(i).alias("at"), short(v).alias("value")) for i, v in enumerate(values.values())])
    long = df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("value").isNotNull())
    counts = long.groupBy("at", "value").agg(F.lit(1).alias("one")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    found = {r["at"]: r["n"] for r in counts.collect()}
    return {n: found.get(i, 0) for i, n in enumerate(values)}
