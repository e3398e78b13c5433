"""Figures of groups at each of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_figures(df: DataFrame, keys: list[Column], figures: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of each row's group; null keys make a group like any other.

    Figures are added up in each task before the shuffle and joined back, so that a key with a large share of all rows
    is never brought together: Spark splits such a key's rows in the join, and sends small tables of figures to all tasks.
    """
    own = {f"__lf_key{i}": k for i, k in enumerate(keys)}
    of = {f"__lf_key{i}": f"__lf_of{i}" for i in range(len(keys))}
    keyed = df.withColumns(own)
    sums = keyed.groupBy(*own).agg(*[x.alias(n) for n, x in figures.items()]).withColumnsRenamed(of)
    same = F.lit(True)
    for a, b in of.items():
        same = same & F.col(a).eqNullSafe(F.col(b))
    return keyed.join(sums, same, "left").drop(*own, *of.values())
