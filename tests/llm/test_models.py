"""The trained operators: quality and toxicity, on made-up text."""

import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm import quality, toxicity

rng = random.Random(2)
WORDS = ["".join(rng.choices("aeioustrn", k=rng.randint(3, 7))) for _ in range(200)]
RUDE = ["grumpf", "blargh", "zonk"]


def plain(n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = [], []
    for i in range(400):
        words = plain(rng.randint(20, 60)).split()
        label = int(i % 4 == 0)
        for _ in range(2 * label):
            words[rng.randrange(len(words))] = rng.choice(RUDE)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, label, 1))
    rows += [(None, "null id", "x"), (900, None, "x"), (901, "", "x"), (902, "?", "x"), (0, "again", "x")]
    labels += [(None, 1, 1), (3, None, None), (4, 1, 1), (77_777, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_documents(spark, toxic):
    docs, labels = toxic
    out = toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 405 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and r["text"] != "again" and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = np.mean([(r["score"] >= 0.5) == any(w in r["text"] for w in RUDE) for r in held])
    assert len(held) > 50 and right > 0.95
    blank = {r["doc_id"]: r["score"] for r in out}
    assert blank[900] == blank[901] == blank[902]


def test_counts_do_not_depend_on_parts(spark, toxic, monkeypatch):
    docs, labels = toxic
    sample = toxicity.labelled_sample(docs, labels, [2, 3, 4])
    whole = toxicity.counted_expressions(sample.coalesce(1)).toPandas()
    monkeypatch.setattr(toxicity, "HELD", 5)
    parts = toxicity.counted_expressions(sample.repartition(60, "toxic")).toPandas()  # most of them empty
    rows = lambda t: sorted(t.itertuples(index=False, name=None))
    assert rows(whole) == rows(parts)


def test_toxicity_without_labels(spark, toxic):
    docs, labels = toxic
    out = toxicity.toxicity(docs, toxicity.train(docs, labels.limit(0)))
    assert {round(r["score"], 6) for r in out.collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []


def test_sample_bound(spark, toxic, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 30)
    docs, labels = toxic
    rows = toxicity.labelled_sample(docs, labels, [1, 2, 3, 4]).collect()
    assert {t: sum(r["toxic"] == t for r in rows) for t in (0, 1)} == {0: 30, 1: 30} and {r["weight"] > 1 for r in rows} == {True}


def counted_by_hand(docs):
    """(toxic, ordinary) counts of expressions, from (text, toxic)."""
    found = Counter(), Counter()
    for text, label in docs:
        for word in re.findall(r"[^\W_]+", (text or "").lower()):
            marked = " " + word + " "
            for i in range(1, len(marked)):
                found[1 - label][marked[max(0, i - toxicity.ORDER + 1) : i + 1]] += 1
    return found


def off_by_hand(counts):
    """A function that gives what modified Kneser-Ney discounts from a count."""
    met = Counter(counts)
    n = [met[k] for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [min(k, max(0.1, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return lambda c: 0.0 if c == 0 else d[min(c, 3) - 1]


def ratio_by_hand(found, word):
    """log P(word | toxic) / P(word | ordinary), by the formulas of Kneser and Ney, one context at a time."""
    types = {e[-k:] for e in found[0] | found[1] for k in range(2, len(e) + 1)}
    follows = Counter(t[1:] for t in types)  # how many different characters each follows
    symbols = sum(len(v) == 1 for v in follows)
    shared_off = {k: off_by_hand([n for v, n in follows.items() if len(v) == k]) for k in range(1, toxicity.ORDER)}
    class_off = [off_by_hand(c.values()) for c in found]

    def shared(v):
        if not v:
            return 1 / (symbols + 1)
        own = {x: n for x, n in follows.items() if len(x) == len(v) and x[:-1] == v[:-1]}
        if not own:
            return shared(v[1:])
        saved = sum(shared_off[len(v)](n) for n in own.values())
        return (own.get(v, 0) - shared_off[len(v)](own.get(v, 0)) + saved * shared(v[1:])) / sum(own.values())

    def of(label, e):
        own = {x: n for x, n in found[label].items() if x[:-1] == e[:-1]}
        if not own:
            return shared(e[1:])
        saved = sum(map(class_off[label], own.values()))
        return (own.get(e, 0) - class_off[label](own.get(e, 0)) + saved * shared(e[1:])) / sum(own.values())

    marked = " " + word + " "
    parts = [marked[max(0, i - toxicity.ORDER + 1) : i + 1] for i in range(1, len(marked))]
    return sum(math.log(of(0, e) / of(1, e)) for e in parts)


def test_ratios_are_those_of_kneser_and_ney(spark):
    texts = [("stupid stupids stupidest you are so stupid", 1), ("zonk you, zonker!", 1), ("You are so kind", 0), ("so so kindly stated; ars ars ars", 0)] * 2
    texts += [(None, 1), ("", 0), ("a_b \u65e5\u672c\u8a9e \u65e5\u672c\u8a9e", 0)]
    found = counted_by_hand(texts)
    counts = toxicity.counted_expressions(spark.createDataFrame(texts, "text string, toxic int"))
    assert {r["expression"]: (r["toxic"], r["ordinary"]) for r in counts.collect()} == {e: (found[0][e], found[1][e]) for e in found[0] | found[1]}
    model = toxicity.ratio_model(counts)
    for word in ("stupid", "stupidly", "zonked", "kind", "so", "are", "unseen", "\u65e5\u672c", "ab", "x" * 40):
        assert model.ratios_of([word])[0] == pytest.approx(ratio_by_hand(found, word), abs=1e-5), word
    both = model.ratios_of(["stupider", "kind"])
    assert both[0] > 3 > 0 > both[1]


def test_all_labelled_documents_are_counted(spark, toxic, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 30)
    docs, labels = toxic
    seen = []
    counted = toxicity.counted_expressions
    monkeypatch.setattr(toxicity, "counted_expressions", lambda d: seen.append((d.collect(), counted(d))) or seen[-1][1])
    toxicity.train(docs, labels)
    rows, counts = seen[0]
    assert len(rows) == len({i for i in range(400) if zlib.crc32(str(i).encode()) % 5 > 1})
    found = counted_by_hand([(r["text"], r["toxic"]) for r in rows])
    assert {r["expression"]: (r["toxic"], r["ordinary"]) for r in counts.collect()} == {e: (found[0][e], found[1][e]) for e in found[0] | found[1]}


def test_what_is_not_kept_backs_off(spark, toxic, monkeypatch):
    docs, labels = toxic
    counts = toxicity.counted_expressions(toxicity.labelled_documents(docs, labels, [2, 3, 4]))
    whole = toxicity.ratio_model(counts)
    monkeypatch.setattr(toxicity, "SHARE", 2e-3)
    rows = counts.collect()
    sums = [sum(r[c] for r in rows) for c in ("toxic", "ordinary")]
    often = {r["expression"] for r in rows if r["toxic"] > 2e-3 * sums[0] or r["ordinary"] > 2e-3 * sums[1]}

    def lean(r):
        likely = sums[0] / sum(sums) * (r["toxic"] + r["ordinary"])
        return (r["toxic"] - likely) / math.sqrt(likely)

    keys = lambda found: sorted(toxicity._key(e) for e in found)
    for leans in ((1.5, 1e9), (0.0, 2.0, 1e9)):  # the first of the second lets too many pass
        monkeypatch.setattr(toxicity, "LEANS", leans)
        model = toxicity.ratio_model(counts)
        z = next(z for z in leans if sum(lean(r) > z for r in rows) <= 1000)
        kept = often | {r["expression"] for r in rows if lean(r) > z}
        assert model.ratios.keys.tolist() == keys(kept) and len(often) < len(kept) < len(whole.ratios.keys) == len(rows)
        assert model.contexts.keys.tolist() == keys({e[:-1] for e in kept})


def test_rare_toxic_expressions_are_kept(spark, monkeypatch):
    rows = [(f"fine {plain(40)}", 0) for _ in range(400)] + [(f"zonk {plain(40)}", 1) for _ in range(200)] + [(f"gribbl {plain(40)}", 1) for _ in range(30)]
    counts = toxicity.counted_expressions(spark.createDataFrame(rows, "text string, toxic int"))
    monkeypatch.setattr(toxicity, "SHARE", 1e-3)
    model = toxicity.ratio_model(counts)
    rare = counts.where("expression = ' gribbl'").first()
    assert rare["toxic"] < 1e-3 * counts.agg({"toxic": "sum"}).first()[0]  # by its share alone it would go
    both = model.leads_of(["gribbl fine", "fine"])
    assert both[0] > 0.1 > 0 > both[1]


def test_models_of_any_partitions_are_equal(spark):
    rows = [(i % 40, f"{'zonk' if i % 3 else 'good'} {plain(5)}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = set()
    for n in (1, 3, 7):
        docs = spark.createDataFrame(rows if n != 3 else rows[::-1], "doc_id long, text string").repartition(n)
        model = toxicity.train(docs, labels)
        seen.add((model.factor, model.constant, model.sent.value.ratios.keys.tobytes(), model.sent.value.ratios.values.tobytes()))
        model.release()
    assert len({x[2:] for x in seen}) == 1 and max(x[0] for x in seen) == pytest.approx(min(x[0] for x in seen), rel=1e-6)


def test_the_model_is_small():
    rng = np.random.default_rng(1)
    figures = lambda n: toxicity.Figures.of(rng.integers(-(2**63), 2**63 - 1, n), rng.normal(size=n))
    model = toxicity.RatioModel(figures(4_000_000), figures(2_000_000))
    assert len(pickle.dumps(model)) < 80e6
    own = figures(1000)
    assert own.get(own.keys)[0].all() and own.get(own.keys)[1].tolist() == own.values.tolist()
    assert not own.get(own.keys + np.uint64(1))[0].any() and not toxicity.no_figures().get(own.keys)[0].any()


def test_scores_of_odd_texts(spark, monkeypatch):
    rows = [("zonk blargh", 1), ("fine day", 0)] * 30
    model = toxicity.ratio_model(toxicity.counted_expressions(spark.createDataFrame(rows, "text string, toxic int")))
    assert model.leads_of([None, "", " ?! "]).tolist() == [0, 0, 0] and model.leads_of([]).tolist() == []
    long = "zonk " * 50_000 + "x" * 200_000
    zonk, most, fine = model.leads_of(["zonk", long, "fine"])
    assert zonk > 0 and 0 < most < zonk and fine < 0
    monkeypatch.setattr(toxicity, "KEPT", 1)
    monkeypatch.setattr(toxicity, "HELD", 2)
    assert model.leads_of(["fine", "zonk", None, long, "zonk"]).tolist() == [fine, zonk, 0, most, zonk]
    docs = spark.createDataFrame([(1, "zonk", 0.5, "a"), (1, "zonk", 0.5, "a"), (None, None, None, None)], "doc_id long, text string, SCORE double, __score string")
    out = toxicity.toxicity(docs, toxicity.ToxicityModel(spark.sparkContext.broadcast(model), 1.0, 0.0))
    assert out.columns == ["doc_id", "text", "__score", "score"]
    got = out.collect()
    assert len(got) == 3 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_kneser_ney_is_a_distribution():
    counts = np.zeros(quality.SIZE, dtype=np.int64)
    for _ in range(30):
        np.add.at(counts, quality.grams(plain(100)), 1)
    p = np.exp(quality.kneser_ney(counts).astype(np.float64)).reshape(-1, quality.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and (p > 0).all()
    assert np.allclose(np.exp(quality.kneser_ney(counts * 0)), 1 / quality.SYMBOLS)


def test_kneser_ney_by_hand():
    counts = np.zeros(quality.SIZE, dtype=np.int64)
    for text in ("the cat sat on the mat", "that cat", "a hat, a bat; a rat", "Thee 42"):
        np.add.at(counts, quality.grams(text), 1)
    digits = lambda g: tuple(int(g) // quality.SYMBOLS**k % quality.SYMBOLS for k in reversed(range(quality.ORDER)))
    levels = {quality.ORDER: Counter({digits(g): int(counts[g]) for g in np.flatnonzero(counts)})}
    for k in range(quality.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off = {k: off_by_hand(level.values()) for k, level in levels.items()}

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        own = {x: n for x, n in levels[len(g)].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        saved = sum(map(off[len(g)], own.values()))
        return (own.get(g, 0) - off[len(g)](own.get(g, 0)) + saved * p(g[1:])) / sum(own.values())

    log_p = quality.kneser_ney(counts)
    for g in [*np.flatnonzero(counts)[::3], *range(5, quality.SIZE, 99_991)]:
        assert log_p[g] == pytest.approx(math.log(p(digits(g))), abs=1e-4)


def test_quality_verdicts_by_hand(spark, graded):
    docs, labels = graded
    model = quality.train(docs, labels)
    judged = quality.quality(docs, model).collect()
    for r in judged:
        mean, limit = model.limits.get(r["lang"], model.limits[None])
        n, total = model.sums(r["text"])
        ppl = math.exp(-(total + mean * quality.SHRINK) / (n + quality.SHRINK))
        assert r["perplexity"] == pytest.approx(ppl, rel=1e-6) and r["threshold"] == limit and r["accepted"] == (r["perplexity"] <= limit)


def test_symbols():
    assert quality.symbols("aZ é9 .#\n").tolist() == [1, 27, 29, 5, 28, 29, 30, 31, 29] and quality.symbols(None).tolist() == []
    assert len(quality.grams("日本😀")) == 3 and max(quality.symbols("日本😀")) < quality.SYMBOLS


@pytest.fixture(scope="module")
def graded(spark):
    rows = [(i, plain(80), "en" if i % 2 else "xx", 1.0) for i in range(120)]
    rows += [(1000 + i, plain(40).upper().replace(" ", "!! "), "en", 1.0) for i in range(20)]
    rows += [(2000, None, "en", 1.0), (2001, "", None, 1.0), (2002, plain(60), "new", 1.0), (None, plain(60), "en", 1.0)]
    labels = [(i, 1) for i in range(100)] + [(1000 + i, 0) for i in range(10)] + [(None, 1), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality(spark, graded):
    docs, labels = graded
    out = quality.quality(docs, quality.train(docs, labels))
    assert out.columns == ["doc_id", "text", "lang", "perplexity", "threshold", "accepted"]
    accepted = {r["doc_id"]: r["accepted"] for r in out.collect()}
    assert len(accepted) == 144 and all(ok == (i is None or not 1000 <= i < 2000) for i, ok in accepted.items())


def test_quality_without_trusted_text(spark, graded):
    docs, labels = graded
    assert quality.quality(docs, quality.train(docs, labels.limit(0))).where("accepted").count() == 144
    assert quality.quality(docs.limit(0), quality.train(docs, labels)).collect() == []


def test_the_sharded_join_gives_the_same(spark, graded):
    docs, labels = graded
    model = quality.train(docs, labels)
    table = spark.createDataFrame(list(enumerate(model.log_p.tolist()))[: quality.SIZE], "gram int, log_p double")
    some = docs.where("doc_id < 30")
    got = {r["doc_id"]: (r["n"], r["total"]) for r in quality.sharded_perplexity(some, table).collect()}
    for r in some.collect():
        n, total = model.sums(r["text"])
        assert got[r["doc_id"]] == (n, pytest.approx(total, rel=1e-5))


def test_words_of_any_expressions_score_as_in_the_whole_model(spark, toxic, monkeypatch):
    docs, labels = toxic
    odd = [(1001, "zonk zonkier", "x"), (1002, "zonk zonkier", "x"), (1003, "日本 grumpfs " + "ab" * 3000, "x"), (1004, "unseen words only", "x")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    told = lambda: {(r["doc_id"], r["text"]): r["score"] for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    whole = told()
    monkeypatch.setattr(toxicity, "SHARE", 2e-3)
    monkeypatch.setattr(toxicity, "LEANS", (4, 1e9))
    model = toxicity.ratio_model(toxicity.counted_expressions(toxicity.labelled_documents(docs, labels, [2, 3, 4])))
    assert not model.whole and len(model.ratios.keys) < model.tables[0].count()
    part = told()
    assert part.keys() == whole.keys() and len(part) == 409
    assert part == pytest.approx(whole, rel=1e-5)
