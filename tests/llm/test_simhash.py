import random

import pytest

from lodeframe.functions.components import components
from lodeframe.llm import simhash

rng = random.Random(3)
WORDS = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]


def text(n):
    return " ".join(rng.choices(WORDS, k=n))


def brute(rows):
    fps = [simhash.text_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((doc_id is None, doc_id or 0, f"{fps[i] - (1 << 64) if fps[i] >> 63 else fps[i]}", str(least.get(root(i)))) for i, (doc_id, _) in enumerate(rows))


def rows():
    out = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "É é"), (None, "lonely words here now"), (7, "x" * 20_000)]
    for i in range(30):
        base = text(200).split()
        for k in range(4):
            base[rng.randrange(200)] = rng.choice(WORDS)
            out.append((100 + 10 * i + k, " ".join(base)))
    return out + [(100, out[8][1]), (None, out[8][1])]


@pytest.mark.parametrize("crowded", [512, 2])
def test_components_against_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, fp int, component_id string")
    out = simhash.near_groups(simhash.fingerprints(docs)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, str(r["fp"]), str(r["component_id"])) for r in out) == brute(data)


def test_one_of_each_group_stays(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, fp int, component_id string")
    out = simhash.without_near_copies(docs)
    assert out.columns == docs.columns
    leaders = {x[3] for x in brute(data)}
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(leaders)


def test_fingerprint_by_definition():
    import xxhash

    words = "the Quick brown fox jumps".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    wanted = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.text_fingerprint("the\tQuick brown\x0bfox  jumps ") == wanted
    assert simhash.text_fingerprint("One\n") == xxhash.xxh64_intdigest(b"one", 42)


def test_spark_hashes_alike(spark):
    import xxhash

    got = spark.sql("SELECT xxhash64('one two three') AS h").first()["h"]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    out = components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r["u"], r["v"]) for r in out} == {(i, 0) for i in range(1, 41)} | {(1000 + i, 1000) for i in range(1, 60)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(simhash.fingerprints(docs)).collect() == []
    assert simhash.without_near_copies(docs).collect() == []


def test_clashing_columns(spark):
    rows = [(1, "a b c d", "x", 5, 7), (2, "a b c d", "y", 5, 7), (3, "something else here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp long, __of_text_hash int")
    out = simhash.without_near_copies(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
