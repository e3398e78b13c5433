"""duplicates.fuzzy_review: groups of rows whose texts resemble one another, for review."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from typing import Literal

import pandas as pd
from pydantic import Field
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.components import components
from ..functions.core import ROW_ID, EngineError, casefolded, collapse, kind, position, pystr, qcol, require_columns, require_new, ustrip
from ..functions.stored import stored
from ..plans.identity import dense, identified
from .base import Counts, OpResult, Params, operator


class FuzzyReview(Params):
    columns: list[str] = Field(min_length=1)
    threshold: float = Field(default=0.88, ge=0.5, le=1.0)
    marker_column: str = "Fuzzy Review Group"
    max_rows: int = Field(default=10_000, gt=0, le=25_000)
    max_comparisons: int = Field(default=1_000_000, gt=0, le=5_000_000)
    #: What max_comparisons bounds: the pairs of rows, as the format has it, or the pairs that are really compared.
    comparisons: Literal["pairs", "made"] = "pairs"


@pandas_udf(T.ArrayType(T.StringType()))
def _letters(texts: pd.Series) -> pd.Series:
    """The characters of a text as a set: each with how many times it has come before."""

    def numbered(text: str) -> list[str]:
        return [f"{c}{i}" for c, n in Counter(text).items() for i in range(n)]

    return texts.map(numbered)


def _least(share: float, size: Column) -> Column:
    """The smallest whole number that isn't below ``share`` of a size, with a margin for rounding."""
    return F.ceil(share * size - 1e-6)


def candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``texts`` (id, t: different, not empty; a stored table) whose ratio can reach the threshold.

    The ratio of two texts is at most twice the characters that they share, as multisets, over both lengths. So two texts
    that reach it share one of the rarest characters of each, among as many as its length leaves open: pairs are met at those
    alone, and stay if their lengths and what follows that character can still make up the number that has to be shared;
    of those, the pairs that do share so many are left. Nothing is lost, and no text is compared with all others.
    """
    letters = stored(texts.select("id", F.explode(_letters("t")).alias("letter")), "letters")
    often = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("often"))
    by_rarity = F.transform(F.array_sort(F.collect_list(F.struct("often", "letter"))), lambda x: x["letter"])
    sorted_ = stored(letters.join(often, "letter").groupBy("id").agg(by_rarity.alias("own")), "sorted-letters")
    size = F.size("own")
    first = size - _least(threshold / (2 - threshold), size) + 1
    rare = sorted_.select("id", size.alias("size"), F.posexplode(F.slice("own", F.lit(1), first.cast("int"))).alias("place", "letter"))
    side = lambda mark: rare.select("letter", *[F.col(c).alias(f"{mark}_{c}") for c in ("id", "size", "place")])
    both = F.col("a_size") + F.col("b_size")
    after = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    enough = (F.least("a_size", "b_size") >= _least(threshold / 2, both)) & (after >= _least(threshold / 2, both))
    met = side("a").join(side("b"), "letter").where((F.col("a_id") < F.col("b_id")) & enough)
    met = met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    of = lambda mark: sorted_.select(F.col("id").alias(mark), F.col("own").alias(f"{mark}_own"))
    shared = F.size(F.array_intersect("a_own", "b_own"))
    whole = met.join(of("a"), "a").join(of("b"), "b")
    return whole.where(shared >= _least(threshold / 2, F.size("a_own") + F.size("b_own"))).select("a", "b")


def alike(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs whose ratio reaches the threshold. ``texts``: id, t, and the first and the last row of each text;
    where rows of two texts come in both orders, either order's ratio counts, as they can differ."""

    @pandas_udf("boolean")
    def reaches(s: pd.Series, u: pd.Series, forth: pd.Series, back: pd.Series) -> pd.Series:
        one = lambda a, b: SequenceMatcher(None, a, b).ratio() >= threshold
        return pd.Series([(f and one(a, b)) or (g and one(b, a)) for a, b, f, g in zip(s, u, forth, back)], dtype="bool")

    side = lambda mark: texts.select(*[F.col(c).alias(f"{mark}_{c}") for c in ("id", "t", "first", "last")])
    met = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    forth, back = F.col("a_first") < F.col("b_last"), F.col("b_first") < F.col("a_last")
    return met.where(reaches("a_t", "b_t", forth, back)).select("a", "b")


def review_groups(rows: DataFrame, threshold: float, most: int | None = None) -> tuple[DataFrame, int]:
    """rows (place, t) to (t, group) for the texts of groups of two rows or more, numbered from 1 by their first rows, and
    how many pairs were compared; more than ``most`` raise. Empty texts are in no group, equal texts in one."""
    whole = rows.where(F.length("t") > 0).groupBy("t")
    texts = whole.agg(F.min("place").alias("id"), F.max("place").alias("last"), F.count(F.lit(1)).alias("rows"))
    texts = stored(texts.withColumn("first", F.col("id")), "fuzzy-texts")
    pairs = stored(candidates(texts.select("id", "t"), threshold), "fuzzy-pairs")
    compared = pairs.count()
    if most is not None and compared > most:
        raise EngineError(f"fuzzy review would make {compared} comparisons, more than {most}")
    roots = components(alike(texts, pairs, threshold).toDF("u", "v"))
    of = texts.join(roots.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    of = stored(of.select("t", "root", "rows"), "fuzzy-roots")
    several = of.groupBy("root").agg(F.sum("rows").alias("rows")).where("rows > 1").select("root")
    numbered = dense(several, "group", [F.col("root")])
    return of.join(numbered, "root").select("t", "group"), compared


@operator("duplicates.fuzzy_review", FuzzyReview)
def fuzzy_review(df: DataFrame, p: FuzzyReview) -> OpResult:
    """Numbers groups of rows whose texts resemble one another; removes nothing.

    Refused above the parameters' bounds, of which ``comparisons="made"`` counts only what the candidate search leaves to
    compare, so that 25,000 rows can be reviewed. Groups are components of the links, found in rounds over all tasks.
    """
    require_columns(df, p.columns)
    require_new(df, [p.marker_column])
    if ROW_ID not in df.columns:
        df = identified(df)
    n = df.count()
    if n > p.max_rows:
        raise EngineError(f"fuzzy review takes at most {p.max_rows} rows")
    if p.comparisons == "pairs" and n * (n - 1) // 2 > p.max_comparisons:
        raise EngineError(f"fuzzy review takes at most {p.max_comparisons} comparisons")
    texts = []
    for c in p.columns:
        t = kind(df, c).simpleString()
        text = pystr(df, c, "")
        if t == "boolean":
            text = F.when(qcol(c), text).otherwise("")
        elif t in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            text = F.when(qcol(c) == 0, "").otherwise(text)
        texts.append(ustrip(collapse(casefolded(text))))
    whole = F.concat_ws(" ", *texts)
    rows = dense(df, "__lf_place", [position(df)]).withColumn("__lf_text", F.when(ustrip(whole) == "", "").otherwise(whole))
    rows = stored(rows, "fuzzy-rows")
    found, compared = review_groups(rows.select(F.col("__lf_place").alias("place"), F.col("__lf_text").alias("t")), p.threshold, p.max_comparisons)
    found = stored(found.toDF("__lf_of", "__lf_group"), "fuzzy-groups")
    joined = rows.join(found, F.col("__lf_text") == F.col("__lf_of"), "left")
    marked = joined.select(*[qcol(c) for c in df.columns], F.col("__lf_group").alias(p.marker_column))
    group = qcol(p.marker_column)
    counts = Counts(marked, {"review_groups": F.max(group), "review_rows": F.count(group)}, {"comparisons": compared})
    return OpResult(marked, counts=counts, warnings=["fuzzy groups are suggestions only; review them before any removal"])
