import hashlib
import re
from collections import defaultdict

import pytest

from lodeframe.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, uid long, kept string"
ROWS = [(i, t, "x", 1, "y") for i, t in enumerate(["a b", "ab", "a  b", None, "", " \n", "A b", "a b", "z" * 50_000, "z " * 50_000])]
ROWS += [(None, "a b", "x", 1, "y"), (2, "a  b", "x", 1, "y"), (2, "a b ", "x", 1, "y"), (20, "q", "x", 1, "y"), (20, "q", "x", 1, "y")]
ROWS += [(100 + i, "hot hot" + " " * (i % 3), "x", 1, "y") for i in range(300)]


def brute(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    return {k: sorted(v) for k, v in groups.items()}


@pytest.mark.parametrize("counters", [16_384, 1_000])
def test_groups(spark, monkeypatch, counters):
    monkeypatch.setattr(exact_dedup, "COUNTERS", counters)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    out = exact_dedup.exact_groups(exact_dedup.digests(docs)).collect()
    groups = brute(ROWS)
    assert len(out) == len(ROWS)
    kept = defaultdict(int)
    for r in out:
        best = groups[r["text_sha256"]][0]
        assert r["keep_id"] == (None if best[1] else best[2])
        assert r["group_size"] == len(groups[r["text_sha256"]])
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and set(kept) == set(groups)


def test_the_frequent_digest_is_found(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = exact_dedup.digests(docs)
    found = [r["digest"] for r in exact_dedup.frequent_digests(rows, "digest").collect()]
    assert found == [hashlib.sha256(b"hothot").hexdigest()]


def test_documents_that_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.without_copies(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    wanted = sorted((ROWS[g[0][3]][0] is None, ROWS[g[0][3]][0] or 0, ROWS[g[0][3]][1] or "") for g in brute(ROWS).values())
    assert got == wanted


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(exact_dedup.digests(docs)).collect() == []
    assert exact_dedup.without_copies(docs).collect() == []
