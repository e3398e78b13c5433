"""Medians, unique counts and spellings of columns against plain ways."""

import math
import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import medians as m
from lodeframe.functions import profile
from lodeframe.functions.cells import cell_text, different
from lodeframe.operators import apply

NAN, INF = float("nan"), float("inf")


def middle(values):
    own = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not own:
        return None
    a, b = own[(len(own) - 1) // 2], own[len(own) // 2]
    return a if a == b else 0.5 * a + 0.5 * b


def columns(n):
    rng = random.Random(n)
    return {
        "even": [rng.random() for _ in range(n)],
        "one value": [3.0] * n,
        "hot": [7.0 if i % 3 else rng.gauss(0, 1) for i in range(n)],
        "hot at the middle": [-1.0] * (n // 2) + [1.0] * (n - n // 2),
        "whole": [float(rng.randrange(100)) for _ in range(n)],
        "nulls": [None if i % 2 else float(i * i) for i in range(n)],
        "none": [None] * n,
        "few": [2.0, 5.0] + [None] * (n - 2),
        "nan": [NAN if i % 4 else float(i) for i in range(n)],
        "some nan": [float(i) if i % 4 else NAN for i in range(n)],
        "inf": [rng.choice([INF, -INF, 1.0, 2.0]) for _ in range(n)],
        "huge": [rng.choice([1e308, -1e308, 5e-324, 0.0, -0.0]) for _ in range(n)],
    }


@pytest.mark.parametrize(("n", "few", "sketch"), [(2, 10_000, 1_000), (999, 5, 10), (5000, 50, 100), (5001, 10_000, 1_000)])
def test_medians(spark, monkeypatch, n, few, sketch):
    monkeypatch.setattr(m, "FEW", few)
    monkeypatch.setattr(m, "SKETCH", sketch)
    own = columns(n)
    df = spark.createDataFrame(list(zip(*own.values())), ", ".join(f"`{c}` double" for c in own)).repartition(3)
    got = m.medians(df, {c: F.col(f"`{c}`") for c in own})
    for c, values in own.items():
        want = middle(values)
        assert got[c] == want or (math.isnan(got[c]) and math.isnan(want)), c


def jobs(spark, run):
    """How many jobs ``run`` takes."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def wide(spark, n):
    return spark.range(400).repartition(3).select(*[F.concat(F.lit("v"), (F.col("id") % (i + 2)).cast("string")).alias(f"t{i}") for i in range(n)], *[(F.col("id") * i).cast("double").alias(f"n{i}") for i in range(n)])


def test_jobs_dont_grow_with_the_columns(spark):
    summary = lambda n: apply("calculate.summary", wide(spark, n), columns=[f"n{i}" for i in range(n)], statistics=["median", "unique_count", "sum"]).aux["Summary Statistics"].collect()
    assert jobs(spark, lambda: summary(1)) >= jobs(spark, lambda: summary(12)) > 0
    profiled = lambda n: profile.profile_columns(wide(spark, n)).collect()
    assert jobs(spark, lambda: profiled(1)) >= jobs(spark, lambda: profiled(12)) > 0


def test_no_row_is_copied_for_each_column(spark):
    df = wide(spark, 4)
    aux = apply("calculate.summary", df, columns=["n0", "n1", "t0"], statistics=["unique_count", "median", "mean"]).aux["Summary Statistics"]
    assert "Expand" not in aux._jdf.queryExecution().executedPlan().toString()


def test_summary_of_many_columns(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50) or None, rng.choice([0.0, -0.0, NAN, 2.5, None]), rng.choice(["1", "x", " ", None, "2.5", "y" * 100])) for _ in range(700)]
    df = spark.createDataFrame(rows, "a long, b double, c string").repartition(4)
    out = {(r["Column"], r["Statistic"]): r["Value"] for r in apply("calculate.summary", df, columns=["a", "b", "c"], statistics=["unique_count", "median", "count", "null_count"]).aux["Summary Statistics"].collect()}
    a = [r[0] for r in rows]
    assert out["a", "unique_count"] == len(set(a)) and out["a", "median"] == statistics.median(x for x in a if x is not None)
    assert out["b", "unique_count"] == 4 and out["b", "median"] == middle([r[1] for r in rows])
    assert out["c", "unique_count"] == 6 and out["c", "median"] == middle([float(r[2]) if r[2] in ("1", "2.5") else None for r in rows])
    assert out["a", "count"] + out["a", "null_count"] == 700
    empty = apply("calculate.summary", df.limit(0), columns=["a"], statistics=["unique_count", "median", "sum"]).aux["Summary Statistics"]
    assert [r["Value"] for r in empty.collect()] == [0.0, None, 0.0]


def test_different_values_of_any_type(spark):
    df = spark.sql("SELECT array(id % 3) a, named_struct('x', id % 2, 'y', null) s, date '2020-01-01' + int(id % 4) d, cast(id % 5 as decimal(9,2)) n, cast(null as string) z, id % 2 = 0 b FROM range(60)")
    assert different(df, {c: cell_text(df, c) for c in df.columns}) == {"a": 3, "s": 2, "d": 4, "n": 5, "z": 0, "b": 2}
    assert different(df, {}) == {}


def test_variations_of_many_columns(spark):
    import unicodedata

    rng = random.Random(8)
    base = ["New York", "Rome", "São Paulo", "Köln", "A-B"]
    spell = lambda t: rng.choice([t, t.upper(), t.replace(" ", "  "), t.replace(" ", "-"), f" {t} ", t + "."])
    rows = [tuple(spell(rng.choice(base)) for _ in range(4)) + (f"u{i}", None if i % 2 else "") for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, `c.d` string, e string, u string, z string")
    got = profile.variations(df, df.columns)

    def plain(values):
        own = {v.strip() for v in values if v and v.strip()}
        fold = lambda v: unicodedata.normalize("NFKC", v).casefold()
        keys = [[" ".join(fold(v).split()) for v in own], ["".join(c for c in fold(v) if c.isalnum()) for v in own]]
        return tuple(sum(k.count(x) for x in set(k) if k.count(x) > 1) for k in keys)

    columns_ = list(zip(*rows))
    assert got == {c: (0, 0) if c == "u" else plain(columns_[i]) for i, c in enumerate(df.columns)} and got["a"][0] > 2
    assert profile.variations(df, []) == {}
