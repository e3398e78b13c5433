import random
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm import fingerprints

rng = random.Random(11)
WORDS = [f"w{i}" for i in range(60)]


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words)


def test_quantiles(spark):
    got = np.array(spark.range(1).select(fingerprints.gamma_quantiles(spark).alias("q")).first()["q"])
    p = 1 - (1 + got) * np.exp(-got)
    assert np.allclose(p, (np.arange(fingerprints.LEVELS) + 0.5) / fingerprints.LEVELS) and got.mean() == pytest.approx(2, abs=0.01)


def test_collisions_are_the_generalised_jaccard_similarity(spark):
    texts = []
    for _ in range(150):
        a = rng.choices(WORDS[: rng.randint(5, 60)], k=rng.randint(5, 400))
        b = a[: rng.randint(0, len(a))] + rng.choices(WORDS, k=rng.randint(1, 200))
        texts += [" ".join(a), " ".join(b)]
    rows = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    signature = {r["doc_id"]: np.array(r["signature"]) for r in rows}
    errors = [(signature[i] == signature[i + 1]).mean() - jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.075


SCHEMA = "doc_id long, text string, place int, tie string"


def edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in rows]
    return {r[0]: t[: len(t) - len(t) // 4] + n[: len(t) // 4] for r, t, n in zip(rows, texts, texts[1:] + texts[:1])}


@pytest.mark.parametrize("n", [0, 1, 2, 200])
def test_edited_neighbours(spark, n):
    rows = [(i * i, None if i == 3 else "" if i == 5 else "é😀" * (i % 50) + f" end{i}", 1, "x") for i in range(n)]
    rows += [(None, "null id first", 1, "x")] if n > 1 else []
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r["doc_id"]: r["edited"] for r in fingerprints.edited_neighbours(docs).collect()} == edited(rows)


def test_query(spark, tmp_path):
    rows = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(12)] + [(20, ""), (21, None), (22, "same"), (23, "same"), (23, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = fingerprints.op4_fingerprints(spark, str(tmp_path)).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert by_id[20]["fingerprint"] == by_id[21]["fingerprint"] == "" and by_id[20]["near_next"] == 1.0 and by_id[21]["near_next"] == 0.0
    assert by_id[22]["fingerprint"] == by_id[23]["fingerprint"] and by_id[22]["near_next"] == 1.0
    assert len(by_id[0]["fingerprint"]) == 4 * fingerprints.SAMPLES and by_id[0]["near_edited"] > by_id[0]["near_next"]


def test_one_id_and_null_ids_in_many_rows(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " + "x" * (i % 40), 1, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tie = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    texts = [r[1] for r in order]
    wanted = sorted((str(r[0]), t, t[: len(t) - len(t) // 4] + n[: len(t) // 4]) for r, t, n in zip(order, texts, texts[1:] + texts[:1]))
    out = fingerprints.edited_neighbours(docs).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["edited"]) for r in out) == wanted
    sizes = Counter(r["bucket"] for r in out)
    assert max(sizes.values()) < 60 and len({r["bucket"] for r in out if r["doc_id"] == 7}) > 5


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "c")], "doc_id long, text string, uid int, signature string")
    assert fingerprints.fingerprints(docs).columns == ["doc_id", "signature"]
    assert fingerprints.fingerprints(docs.limit(0)).collect() == []
