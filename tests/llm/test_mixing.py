import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodeframe.llm.common import word_count
from lodeframe.llm.mixing import OP1_SQL, hash_key, mix, mixed_documents, op1_mixing

SCHEMA = "doc_id long, text string, source string, sid int, weight string, `__mix_size` string"
ROWS = [(i, "w " * (i % 7), "abc"[i % 3] if i % 11 else None, 7, "x", "y") for i in range(60)]
ROWS += [(None, "a b", "a", 1, "x", "y"), (None, None, None, 1, "x", "y"), (5, "a b c", "b", 1, "x", "y"), (5, "a b c", "b", 1, "x", "y")]


def filled(totals, weights, share, limit):
    """Targets by handing the excess on until none is above its limit."""
    names = sorted((n for n in totals if n is not None)) + [None] * (None in totals)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, rest = {}, set(names), share * sum(totals.values())
    while free:
        total = sum(w[n] for n in free)
        over = {n for n in free if rest * w[n] / total > limit * totals[n]}
        if not over:
            return target | {n: rest * w[n] / total for n in free}
        for n in over:
            target[n] = limit * totals[n]
            rest -= target[n]
        free -= over
    return target


@pytest.mark.parametrize(("share", "weights"), [(1.5, (5, 2, 1)), (0.3, (1,)), (3.0, (5, 2, 1))])
def test_targets_and_budgets(spark, share, weights):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = mix(docs.withColumn("size", word_count(docs["text"])), share=share, weights=weights)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    totals, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    wanted = filled(totals, weights, share, 2.0)
    for r in rows:
        assert r["source_size"] == totals[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
    assert all(abs(taken[s] - wanted[s]) < 1 for s in totals)
    again = mix(docs.repartition(5).withColumn("size", word_count(docs["text"])), share=share, weights=weights)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_documents_repeat_and_the_last_is_cut(spark):
    docs = spark.createDataFrame(
        [(i, f" a\tb  c d{i}\n", "s" if i % 2 else "t", 99, "keep") for i in range(20)],
        "doc_id long, text string, source string, n_chars long, taken string",
    )
    out = mixed_documents(docs, weights=(5, 1), share=1.13)
    assert out.columns == docs.columns
    rows = out.collect()
    words = defaultdict(int)
    for r in rows:
        words[r["source"]] += len(r["text"].split())
        whole = f" a\tb  c d{r['doc_id']}\n"
        assert whole.startswith(r["text"]) and r["taken"] == "keep"
        assert r["n_chars"] == (99 if r["text"] == whole else len(r["text"]))
    assert sum(words.values()) == pytest.approx(1.13 * 80, abs=2)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, size long, n_chars long")
    assert mix(docs).collect() == [] and mixed_documents(docs).collect() == []


def test_texts_without_words_are_in_no_mix(spark):
    docs = spark.createDataFrame([(1, " ", "a"), (2, None, "a"), (3, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(docs.withColumn("size", word_count(docs["text"]))).collect()] == [0, 0, 0]
    assert mixed_documents(docs).count() == 0


@pytest.mark.parametrize("share", [0.37, 1.13, 1.5])
def test_the_mix_is_what_is_taken(spark, share):
    rows = [(i % 9 if i % 4 else None, " x" * (1 + i % 5) + f" {i % 3}", "ab"[i % 2] if i % 5 else None, i) for i in range(120)]
    rows += [(3, "same same same", "a", 0)] * 40 + [(None, "same same", "b", 0)] * 40 + [(4, "", "a", 0), (5, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, of int").drop("of").repartition(4)
    sized = docs.select("*", word_count(docs["text"]).alias("size"), F.xxhash64("text").alias("tie"))
    wanted, got = Counter(), Counter()
    for r in mix(sized, share=share, tie="tie").where("taken > 0").collect():
        wanted[r["doc_id"], r["source"], r["text"][:8]] += r["taken"]
    out = mixed_documents(docs, share=share).collect()
    for r in out:
        got[r["doc_id"], r["source"], r["text"][:8] if r["text"] in {x[1] for x in rows} else "cut"] += len(r["text"].split())
    cuts = [r for r in out if r["text"] not in {x[1] for x in rows}]
    assert sum(got.values()) == sum(wanted.values()) and len(cuts) <= 3
    by_id = lambda c: {k: sum(n for (i, s, _), n in c.items() if (i, s) == k) for k in {(i, s) for i, s, _ in c}}
    assert by_id(got) == by_id(wanted)


def test_null_ids_spread_by_their_texts(spark, tmp_path):
    import duckdb

    rows = [(None if i % 3 else i, "w " * (i % 5) + str(i % 400), "ab"[i % 2]) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    keys = docs.where("doc_id IS NULL").select(hash_key(F.col("doc_id"), tie=F.xxhash64("text")).alias("k"))
    assert keys.select(F.shiftright("k", 56)).distinct().count() == 16
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "size", "source_size", "target", "taken", "source"]
    got = sorted(map(repr, (tuple(r) for r in op1_mixing(spark, str(tmp_path)).select(*columns).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({OP1_SQL})").fetchall()))
