import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, Rank string, score double"


def brute(rows):
    """rows of (id, label, whole numbers)."""
    out = []
    for a, label, v in rows:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a]
        for minus, p, other in sorted(s for s in scored if s[2] == label)[:5]:
            score = -minus
            there = sorted(s for s in scored if s[2] != label and 50 * score <= -100 * s[0] <= 95 * score)
            out += [(a, p, i + 1, n[1], score, -n[0]) for i, n in enumerate(there[:3])]
    return sorted(out)


def taken(rows):
    """What takes part of a table's rows, as the contract of op13 has it."""
    best = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        best[i] = min(best.get(i, (label, v)), (label, v))
    return [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, (l, v) in best.items()]


def table(n=400, seed=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.randrange(4)
        rows.append((i, [0.6 * x + 0.25 * rng.gauss(0, 1) for x in centre[c]], c if rng.random() < 0.7 else rng.randrange(4)))
    hot = rows[7][1]
    rows = [(i, hot if i % 3 == 0 else v, l) for i, v, l in rows]  # a third are one vector
    rows += [(1000, None, 1), (1050, [1.0, None], 1), (1100, [1.0, float("nan")], 1), (1150, [1.0, -float("inf")], 2), (1200, [0.5] * 8, None)]
    rows += [(1250, [], 1), (1251, [0.25, 0.5], 1), (1300, [0.5] * 12, 2), (None, [0.5] * 8, 2), (-50, [0.5] * 8, 1)]
    rows += [(50, hot, 3), (50, hot, 0), (51, hot, 1), (51, hot, 1)]
    return [(*r, "x", 0.5) for r in rows]


@pytest.mark.parametrize(("block", "products", "size"), [(16 << 20, 1 << 20, 10_000), (300, 50, 64)])
def test_query(spark, tmp_path, monkeypatch, block, products, size):
    monkeypatch.setattr(hn, "BLOCK_BYTES", block)
    monkeypatch.setattr(hn, "PRODUCTS", products)
    monkeypatch.setattr(hn, "ROWS", size)
    rows = table(150 if block < 1000 else 400)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = hn.op13_hard_negatives(spark, str(tmp_path))
    assert dict(out.dtypes) == {c: "int" if c == "rank" else "bigint" for c in out.columns}
    got = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    wanted = brute(taken(rows))
    assert sorted(got) == wanted and len(wanted) > 10


def test_sql_on_whole_vectors(spark, tmp_path):
    rows = [r for r in table() if r[1] and len(r[1]) == 8 and r[0] is not None and r[0] not in (50, 51)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        found = db.execute(hn.OP13_SQL).fetchall()
    assert sorted(found) == brute(taken(rows))


def test_products_beyond_doubles():
    a = np.array([[2.0**40, 1.0], [3.0, -5.0]])
    b = np.array([[2.0**20, 1.0], [2.0**40, 7.0], [-(2.0**40), 0.0]])
    assert hn.products(a, b).tolist() == [[2**60 + 1, hn.MOST, hn.LEAST], [3 * 2**20 - 5, 3 * 2**40 - 35, -3 * 2**40]]
    assert hn.products(a[:0], b).shape == (0, 3)


def test_best_is_mergeable():
    rng = np.random.default_rng(2)
    owner, score, ids = rng.integers(0, 5, 600), rng.integers(-3, 3, 600), rng.permutation(600)
    whole, parts = hn.Best(5, 4), hn.Best(5, 4)
    whole.add(owner, score, ids)
    for i in range(0, 600, 37):
        part = slice(i, i + 37)
        enters = parts.may_enter(np.arange(5), score[None, part].repeat(5, 0), ids[part])
        own = enters[owner[part], np.arange(len(owner[part]))]
        parts.add(owner[part][own], score[part][own], ids[part][own])
    for name in ("owner", "score", "id"):
        assert getattr(whole, name).tolist() == getattr(parts, name).tolist()


def test_labels_of_text_and_empty_tables(spark):
    rows = spark.createDataFrame([(0, "a", [10.0]), (1, "a", [10.0]), (2, "b", [6.0]), (3, "b", [9.6])], "vec_id long, label string, vector array<double>")
    (row,) = hn.hard_negatives(rows, F.col("vec_id") == 0).collect()
    assert tuple(row) == (0, 1, 1, 2, 100, 60)
    assert hn.hard_negatives(rows.limit(0), F.col("vec_id") == 0).collect() == []
    assert hn.hard_negatives(rows, F.lit(False)).collect() == []
