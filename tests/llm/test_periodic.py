import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodeframe.llm import periodic


def brute(words, least=12):
    """All runs by comparing every word with the one p before."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)  # smaller periods come first
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a b " * 6, "x " * 3000, "ab ab " * 40, "a\x0bb\x0ca\rb " * 9]
    out += ["a b a b a b a b a b a b c a b a b a b a b a b a b", "p q r s t u p q r s t u p q r s t u x p q r s t u p q r s t u"]
    out += [" ".join(rng.choices("ab", k=rng.randrange(1, 120))) for _ in range(60)]
    out += [" ".join(rng.choices("abcdef", k=rng.randrange(1, 60)) * rng.randrange(1, 6)) for _ in range(60)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), " ".join(f"w{i % 977}" for i in range(5000))]


@pytest.mark.parametrize(("words", "pairs"), [(60_000, 1 << 20), (50, 7)])
def test_against_every_period(monkeypatch, words, pairs):
    monkeypatch.setattr(periodic, "WORDS", words)
    monkeypatch.setattr(periodic, "PAIRS", pairs)
    given = texts()
    counts, runs, rest = periodic._results(given, 12)
    for text, n, got, left in zip(given, counts, runs, rest, strict=True):
        said = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        wanted = brute(said)
        assert n == len(said)
        assert [(r["start"], r["length"], r["period"]) for r in got] == wanted
        assert left == collapsed(said, wanted)


def test_agreement_against_comparing():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 3, 300), 9)
    a, b = rng.integers(0, 301, (2, 2000))
    a, b = a[a != b], b[a != b]
    for i, j, n in zip(a, b, periodic.Agreement(text)(a, b), strict=True):
        wanted = next(k for k in range(301) if max(i, j) + k > 300 or text[i + k] != text[j + k])
        assert n == wanted


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts())] + [(None, "a b " * 9, "x", [1]), (3, "a " * 20, "x", [1]), (3, "a " * 20, "x", [1])]
    rows += [(1000 + i, " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(0, 90))), "x", [1]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string, collapsed array<int>")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, (tuple(r) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect())))
    wanted = []
    for doc_id, text, *_ in rows:
        words = planted(doc_id, text)
        runs = brute(words)
        longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = 1000 * longest[1] // longest[2] if runs else None
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((doc_id, len(runs), *longest, milli, digest(lines), digest(collapsed(words, runs))))
    assert got == sorted(map(repr, wanted))
    assert sum(w[1] > 0 for w in wanted[-200:]) > 5  # planted ones among them


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 12, 5)], "`my.id` long, Text string, runs int")
    (row,) = periodic.periodic_runs(docs, "my.id").collect()
    assert row.asDict(True) == {"doc_id": 1, "n_words": 12, "runs": [{"start": 0, "length": 12, "period": 1}], "collapsed": "a"}
    assert periodic.periodic_runs(docs.limit(0), "my.id").collect() == []
