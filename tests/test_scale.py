"""What keeps large tables right: stable row ids, groups of any size, ranges."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeframe.functions.core import ROW_ID, EngineError
from lodeframe.functions.stored import release, stored
from lodeframe.operators import apply
from lodeframe.operators.grouping import with_figures
from lodeframe.plans.identity import dense, identified

rng = random.Random(5)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_ids_of_whole_files_are_their_places(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(f"{tmp_path}/t")
    df = identified(spark.read.parquet(f"{tmp_path}/t"), 10)
    first = {r["id"]: r[ROW_ID] for r in df.collect()}
    assert sorted(first.values()) == list(range(11, 1011))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # other splits, as on a cluster of another size
    try:
        assert {r["id"]: r[ROW_ID] for r in df.collect()} == first
        assert {r["id"]: r[ROW_ID] for r in identified(spark.read.parquet(f"{tmp_path}/t"), 10).collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    some = identified(spark.read.parquet(f"{tmp_path}/t").where("id % 3 = 0"))
    assert sorted(r[ROW_ID] for r in some.collect()) == list(range(1, 335))


def test_row_ids_of_tables_that_repeat_or_drop_rows_of_files(spark, tmp_path):
    spark.range(40).repartition(2).write.parquet(f"{tmp_path}/t")
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/two")
    whole, two = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/two")
    tables = {
        "exploded": two.where("id = 1").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))),
        "united": whole.union(whole),
        "sampled": whole.sample(True, 1.5, 3),
        "read twice": spark.read.parquet(f"{tmp_path}/two", f"{tmp_path}/two"),
        "half of twice": spark.read.parquet(f"{tmp_path}/two", f"{tmp_path}/two").where("id = 1"),
        "joined": whole.crossJoin(two.select(F.col("id").alias("other"))),
        "named oddly": whole.select(F.col("id").alias(" parquet Exchange")),
        "of its own metadata": whole.withColumn("_metadata", F.lit("x")),
    }
    for name, df in tables.items():
        ids = [r[ROW_ID] for r in identified(df, 5).collect()]
        assert sorted(ids) == list(range(6, 6 + df.count())), name


def test_row_ids_stay_when_the_table_is_run_again(spark):
    df = identified(spark.range(500).repartition(7).withColumn("x", F.rand(3)))
    once = {r["id"]: r[ROW_ID] for r in df.collect()}
    spark.catalog.clearCache()
    assert sorted(once.values()) == list(range(1, 501)) and {r["id"]: r[ROW_ID] for r in df.collect()} == once
    assert "InMemoryTableScan" not in plan_of(df)
    ordered = dense(df, "n", [F.col("x")])
    rows = sorted(ordered.collect(), key=lambda r: r["x"])
    spark.catalog.clearCache()
    assert [r["n"] for r in rows] == list(range(1, 501)) and sorted(ordered.collect(), key=lambda r: r["x"]) == rows


def test_stored_keeps_any_column(spark):
    df = spark.createDataFrame([(1, "a", None)], "a long, `b c,d;=` string, v void")
    df = df.toDF("Name", "b c,d;=", "name")
    back = stored(df, "test")
    assert back.columns == df.columns and back.dtypes == df.dtypes and back.collect() == df.collect()
    assert release(spark) > 0 and release(spark) == 0


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, "hot" if i % 10 else None if i % 20 else f"k{i % 7}", rng.choice([1.0, 2.5, None]), rng.randrange(50)) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "id long, g string, v double, o long").repartition(6)


def test_running_totals_of_a_group_that_fills_many_ranges(spark, skewed):
    rows, df = skewed
    out = apply("calculate.column", df.withColumn(ROW_ID, F.col("id")), action={"kind": "running_total", "output": "r", "value_column": "v", "group_by": ["g"], "order_by": ["o"]}).df
    assert "__lf_" not in " ".join(c for c in out.columns if c != ROW_ID)
    table = pd.DataFrame(rows, columns=["id", "g", "v", "o"]).astype({"v": float}).sort_values(["o", "id"])
    table["r"] = table["v"].fillna(0).groupby(table["g"].fillna("none")).cumsum().where(table["v"].notna())
    wanted = dict(zip(table["id"], table["r"]))
    got = {r["id"]: r["r"] for r in out.collect()}
    assert len(got) == 2000 and all(got[i] == pytest.approx(x) if x == x else got[i] is None for i, x in wanted.items())


def test_groups_are_never_brought_together(spark, skewed):
    rows, df = skewed
    df = df.withColumn(ROW_ID, F.col("id"))
    marked = apply("duplicates.handle", df, keys=["g"], mode="mark").df
    kept = apply("duplicates.handle", df, keys=["g"], mode="move", keep="last")
    total = apply("calculate.column", df, action={"kind": "group_total", "output": "t", "group_by": ["g"], "value_column": "v", "aggregation": "sum"}).df
    for out in (marked, kept.df, kept.aux["Duplicates"], total):
        assert "Window" not in plan_of(out)
    groups = pd.Series([r[1] or "none" for r in rows])
    sizes = groups.map(groups.value_counts())
    assert {r["id"]: r["Is Duplicate"] for r in marked.collect()} == dict(enumerate((sizes > 1).tolist()))
    last = {g: i for i, g in enumerate(groups)}
    assert {r["id"] for r in kept.df.collect()} == set(last.values()) and kept.aux["Duplicates"].count() == 2000 - len(last)
    assert kept.counts["duplicate_rows"] == 2000 - len(last)
    assert {r["t"] for r in total.where("g = 'hot'").collect()} == {sum(r[2] or 0 for r in rows if r[1] == "hot")}
    report = apply("quality.validate", df, rules=[{"kind": "duplicate_id", "columns": ["g"]}]).report
    assert report.issues[0].affected_rows == int((sizes > 1).sum())


def test_figures_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    assert sorted((str(r["k"]), r["n"]) for r in with_figures(df, [F.col("k")], {"n": F.sum("v")}).collect()) == [("None", 3), ("None", 3), ("a", 3)]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_fuzzy_groups_are_those_of_all_pairs(spark, threshold):
    from difflib import SequenceMatcher

    texts = ["".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(150)] + ["jon smith", "john smith", "jon smith"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn(ROW_ID, F.col("i") + 1)
    out = apply("duplicates.fuzzy_review", df, columns=["t"], threshold=threshold, max_comparisons=20_000).df.collect()
    group = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(group)
        for a in range(len(texts)):
            for b in range(a + 1, len(texts)):
                if texts[a] and texts[b] and SequenceMatcher(None, texts[a], texts[b]).ratio() >= threshold:
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    several = {g for g in group if group.count(g) > 1}
    numbers = {g: k + 1 for k, g in enumerate(sorted(several))}
    assert {r["i"]: r["Fuzzy Review Group"] for r in out} == {i: numbers.get(g) for i, g in enumerate(group)}


def _names(n, seed):
    own = random.Random(seed)
    firsts = ["".join(own.choices("abcdefghijklmnoprstuvwz", k=own.randint(3, 8))) for _ in range(400)]
    lasts = ["".join(own.choices("abcdefghijklmnoprstuvwz", k=own.randint(4, 11))) for _ in range(900)]
    return [f"{own.choice(firsts)} {own.choice(lasts)} {own.randint(1, 99)}" for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.75, 0.88, 0.95])
def test_candidates_of_similar_texts_lose_no_pair(spark, threshold):
    from difflib import SequenceMatcher

    from lodeframe.operators import fuzzy

    own = random.Random(9)
    texts = _names(250, 1)
    texts += [t[:k] + own.choice("xyz") + t[k + 1 :] for t in texts[:80] for k in [own.randrange(len(t))]]
    texts += [t + t[-2:] for t in texts[:40]] + ["x" * k for k in (1, 2, 9, 10, 11)]
    texts += ["".join(own.choices("abcde ", k=260)) for _ in range(3)]
    texts += [texts[-1][:200] + "q" + texts[-1][200:], "".join(own.choices("ab", k=900))]  # long texts have characters that the ratio skips
    texts = sorted(set(texts))
    table = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    found = {tuple(r) for r in fuzzy.candidates(table, threshold).collect()}
    near = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if SequenceMatcher(None, texts[a], texts[b]).ratio() >= threshold}
    assert near <= found and len(near) > 20
    assert len(found) < len(texts) * (len(texts) - 1) / 2 * {0.75: 0.05, 0.88: 0.02, 0.95: 0.01}[threshold]


def test_fuzzy_review_of_as_many_rows_as_the_format_takes(spark):
    names = _names(24_000, 2)
    names += [names[i].replace(" ", "  ") for i in range(0, 2000, 4)] + [names[i] + "x" for i in range(500)]
    df = spark.createDataFrame(list(enumerate(names)), "i long, t string").repartition(4)
    ask = {"columns": ["t"], "threshold": 0.95, "max_rows": 25_000, "max_comparisons": 5_000_000}
    with pytest.raises(EngineError, match="comparisons"):
        apply("duplicates.fuzzy_review", df, **ask)
    with pytest.raises(EngineError, match="would make"):
        apply("duplicates.fuzzy_review", df, **ask | {"max_comparisons": 10}, comparisons="made")
    out = apply("duplicates.fuzzy_review", df, **ask, comparisons="made")
    group = {r["i"]: r["Fuzzy Review Group"] for r in out.df.collect()}
    assert len(group) == 25_000 and all(group[24_000 + k] == group[4 * k] is not None for k in range(500))
    assert all(group[24_500 + i] == group[i] is not None for i in range(500))
    assert out.counts["comparisons"] < 1_000_000 and out.counts["review_groups"] == max(g for g in group.values() if g)
