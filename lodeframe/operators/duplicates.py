"""duplicates.handle: marks, removes, moves or merges rows with equal keys."""

from __future__ import annotations

from typing import Literal

from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import ORDER, ROW_ID, EngineError, blank, is_hidden, kind, position, pystr, qcol, require_columns, require_new, visible, with_columns
from ..plans.identity import identified
from .base import Counts, OpResult, Params, operator
from .grouping import with_figures


class MergeRule(Params):
    column: str
    strategy: Literal["first_non_blank", "last_non_blank", "require_equal", "join_unique"]
    delimiter: str = "; "


class Duplicates(Params):
    keys: list[str] = Field(default_factory=list)
    mode: Literal["mark", "remove", "move", "merge_complementary"]
    keep: Literal["first", "last"] = "first"
    marker_column: str = "Is Duplicate"
    duplicate_table_name: str = "Duplicates"
    merge_rules: list[MergeRule] = Field(default_factory=list)


def key_columns(df: DataFrame, keys: list[str]) -> list[Column]:
    """Null equals null and NaN equals NaN; -0.0 and 0.0 differ, as their texts do."""
    out = []
    for k in keys:
        c = qcol(k)
        out.append(c.cast("string") if isinstance(kind(df, k), (T.DoubleType, T.FloatType)) else c)
    return out


def _merged(df: DataFrame, keys: list[str], p: Duplicates) -> DataFrame:
    others = [c for c in visible(df) if c not in keys]
    if sorted(r.column for r in p.merge_rules) != sorted(others):
        raise EngineError("merging takes exactly one rule for each column that isn't a key")
    at = position(df)
    rows = df.withColumn("__lf_at", at)
    first = p.keep == "first"
    pick = (lambda c: F.min_by(c, F.col("__lf_at"))) if first else (lambda c: F.max_by(c, F.col("__lf_at")))
    values = [pick(qcol(c)).alias(c) for c in df.columns if c in keys or is_hidden(c)]
    checks = []
    for r in p.merge_rules:
        c = qcol(r.column)
        filled = ~blank(c)
        where = F.when(filled, F.col("__lf_at"))
        if r.strategy == "last_non_blank":
            new = F.max_by(c, where)
        elif r.strategy == "join_unique":
            continue
        else:
            new = F.min_by(c, where)
            if r.strategy == "require_equal":
                own = F.when(filled, c)
                checks.append((r.column, ~F.min(own).eqNullSafe(F.max(own))))
        values.append(new.alias(r.column))
    groups = [c.alias(f"__lf_key{i}") for i, c in enumerate(key_columns(df, keys))]
    if checks:
        seen = rows.groupBy(*groups).agg(*[x.alias(f"x{i}") for i, (_, x) in enumerate(checks)])
        bad = seen.agg(*[F.coalesce(F.bool_or(f"x{i}"), F.lit(False)).alias(f"x{i}") for i in range(len(checks))]).first()
        for i, (name, _) in enumerate(checks):
            if bad[i]:
                raise EngineError(f"conflicting values of {name!r} can't be merged")
    merged = rows.groupBy(*groups).agg(*values, F.min("__lf_at").alias("__lf_first"))
    if several := [r for r in p.merge_rules if r.strategy == "join_unique"]:
        texts = _unique_texts(rows, df, groups, several)
        merged = joined_by_keys(merged, texts, [f"__lf_key{i}" for i in range(len(groups))])
    return merged.select(*[qcol(c) for c in df.columns if c != ORDER], F.col("__lf_first").alias(ORDER))


def joined_by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the same keys, null equal to null; both have a row for each combination of keys."""
    of = {k: f"__lf_of{i}" for i, k in enumerate(keys)}
    match = [qcol(k).eqNullSafe(qcol(o)) for k, o in of.items()]
    return left.join(right.withColumnsRenamed(of), match).drop(*of.values())


def _unique_texts(rows: DataFrame, df: DataFrame, groups: list[Column], rules: list[MergeRule]) -> DataFrame:
    """By key, each rule's column as its different texts in the order in which they come first.

    The first place of each (key, column, text) is found in each task before anything is shuffled; only the different
    texts of a key meet, however many rows it has.
    """
    cells = [F.struct(F.lit(i).alias("rule"), pystr(df, r.column).alias("text"), (~blank(qcol(r.column))).alias("filled")) for i, r in enumerate(rules)]
    long = rows.select(*groups, "__lf_at", F.explode(F.array(*cells)).alias("__lf_cell"))
    keys = [f"__lf_key{i}" for i in range(len(groups))]
    cell = lambda n: F.col(f"__lf_cell.{n}")
    # a key without any text keeps its row
    first = long.groupBy(*keys, cell("rule").alias("rule"), F.when(cell("filled"), cell("text")).alias("text")).agg(F.min("__lf_at").alias("at"))

    def listed(i: int, r: MergeRule) -> Column:
        own = F.collect_list(F.when((F.col("rule") == i) & F.col("text").isNotNull(), F.struct("at", "text")))
        texts = F.transform(F.array_sort(own), lambda x: x["text"])
        return F.when(F.size(texts) > 0, F.array_join(texts, r.delimiter)).alias(r.column)

    return first.groupBy(*keys).agg(*[listed(i, r) for i, r in enumerate(rules)])


@operator("duplicates.handle", Duplicates, destructive=lambda p: p.mode != "mark")
def handle_duplicates(df: DataFrame, p: Duplicates) -> OpResult:
    """Marks, removes, moves or merges rows with equal keys."""
    if any(is_hidden(k) for k in p.keys):
        raise EngineError("hidden columns can't be keys")
    keys = p.keys or visible(df)
    require_columns(df, keys)
    if ROW_ID not in df.columns:
        df = identified(df)
    at, own = position(df), key_columns(df, keys)
    groups = df.select(*[c.alias(f"k{i}") for i, c in enumerate(own)]).groupBy(*[f"k{i}" for i in range(len(own))]).count()
    surplus_rows = F.sum("count") - F.count(F.lit(1))
    if p.mode == "mark":
        require_new(df, [p.marker_column])
        sized = with_figures(df, own, {"__lf_size": F.count(F.lit(1))})
        marked = with_columns(sized, {p.marker_column: F.col("__lf_size") > 1}).drop("__lf_size")
        several = F.sum(F.when(F.col("count") > 1, F.col("count")))
        return OpResult(marked, counts=Counts(groups, {"duplicate_rows": surplus_rows, "duplicate_group_rows": several}))
    if p.mode == "merge_complementary":
        return OpResult(_merged(df, keys, p), counts=Counts(groups, {"duplicate_rows": surplus_rows}))
    best = F.min(at) if p.keep == "first" else F.max(at)
    ranked = with_figures(df, own, {"__lf_best": best})
    kept = ranked.where(at == F.col("__lf_best")).drop("__lf_best")
    surplus = ranked.where(at != F.col("__lf_best")).drop("__lf_best")
    counts = Counts(groups, {"duplicate_rows": surplus_rows})
    return OpResult(kept, aux={p.duplicate_table_name: surplus} if p.mode == "move" else {}, counts=counts)
