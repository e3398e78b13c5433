"""Toxicity by class-conditional Kneser-Ney models of words.

Two models, of toxic and of ordinary documents, predict each character of a word, and its end, from those before it: at
most ``ORDER`` - 1 of them, or all from the word's start. Each class discounts its own counts by Chen and Goodman's
estimates and gives what it saves to lower orders that both share: continuation counts, of how many different characters
an expression follows in either class. A character that neither class attests after its context is thus as likely in both but
for what the contexts save, and inflected or rare expressions are known by the stems that they begin with.

Toxic documents hold ordinary words as well, so that the toxic likelihood of a word is ``TOXIC_SHARE`` from the toxic
model and the rest from the ordinary one. A document's two log-likelihoods are divided by its words and compared; a
logistic regression on the logarithm of what the toxic one is ahead makes this a score between 0 and 1.

No expression is left out of the models. Up to 2 / ``SHARE`` of them are broadcast whole. Of more, the frequent and the leaning
ones are, with the same figures as in the whole model, and score the words that consist of them where the texts are; every
other word gets its figure from the stored tables of all expressions and contexts, by joins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from xxhash import xxh64_intdigest

from .common import TEXT_ROWS, discounts, fresh, if_small, quoted, written

#: Labelled documents of each class that the regression is fitted on at most, by hash.
SAMPLE = 10_000
#: Characters in the longest expressions, the predicted one included.
ORDER = 7
#: An expression is broadcast if it makes up more than this share of a class's counts, which 2 / SHARE do at most; words with
#: any that isn't are looked up by joins.
SHARE = 1e-6
#: Broadcast too, however rare: expressions that toxic documents have more often than their part of all expressions makes
#: likely, by so many standard deviations; the first of these numbers that at most 2 / SHARE expressions pass, so that all are
#: broadcast if they are no more.
LEANS = (-math.inf, 4, 8, 16, 32, 64, 128, 256, 1024, 1 << 16, 1 << 31)
#: The part of a toxic document's words that the toxic model speaks for.
TOXIC_SHARE = 0.02
#: What is added to the lead of the toxic log-likelihood before its logarithm is taken.
FLOOR = 0.005
#: Different words that a Python worker counts or looks up at once, but for a document's.
HELD = 150_000
#: Different words that a Python worker keeps the leads of at most; past it they start anew.
KEPT = 250_000
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def expressions(word: str) -> list[str]:
    """For each character of a word between blanks but the first blank, what predicts it and the character itself."""
    marked = f" {word} "
    short = [marked[:i] for i in range(2, min(ORDER, len(marked) + 1))]
    return short + [marked[i : i + ORDER] for i in range(len(marked) - ORDER + 1)]


def _key(expression: str) -> int:
    """Spark's xxhash64 of a text, unsigned."""
    return xxh64_intdigest(expression.encode(), 42)


@dataclass
class Figures:
    """Numbers by the hashes of texts: 12 bytes for each entry."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Figures:
        keys = keys.astype(np.int64).view(np.uint64)
        by = np.argsort(keys)
        return cls(keys[by], values[by].astype(np.float32))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether there is an entry for each key, and its value, or 0."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return there, np.where(there, self.values[at], 0.0)


def no_figures() -> Figures:
    return Figures.of(np.empty(0), np.empty(0))


@dataclass
class RatioModel:
    """ratios: logarithms of toxic over ordinary probability of expressions' last characters. contexts: the same of any
    other character after a context. tables: None if these are all; else both, of all expressions and contexts, as stored
    tables, and ``whole`` is false, in tasks too."""

    ratios: Figures = field(default_factory=no_figures)
    contexts: Figures = field(default_factory=no_figures)
    leads: dict[str, float] = field(default_factory=dict)
    tables: tuple[DataFrame, DataFrame] | None = None
    whole: bool = True

    def __getstate__(self) -> dict:
        return {"ratios": self.ratios, "contexts": self.contexts, "leads": {}, "tables": None, "whole": self.whole}

    def ratios_of(self, words: list[str]) -> np.ndarray:
        """The logarithms of toxic over ordinary probability of words, many at once; NaN for those that the tables tell."""
        each = [expressions(w) for w in words]
        every = [e for own in each for e in own]
        there, found = self.ratios.get(np.array([_key(e) for e in every], np.uint64))
        missing = np.flatnonzero(~there)
        if self.whole:
            found[missing] = self.contexts.get(np.array([_key(every[i][:-1]) for i in missing.tolist()], np.uint64))[1]
        else:
            found[missing] = np.nan
        return np.add.reduceat(found, np.cumsum([0, *map(len, each[:-1])]))

    def learn(self, words: list[str]) -> None:
        leads = np.log1p(TOXIC_SHARE * np.expm1(np.minimum(self.ratios_of(words), 30.0)))
        self.leads.update(zip(words, leads.tolist(), strict=True))

    def leads_of(self, texts: list[str | None]) -> np.ndarray:
        """What each text's toxic log-likelihood is ahead of the ordinary one for each word; 0 for a text without words, NaN
        for one with words that the tables tell."""
        return np.array([math.nan if rest else own / n if n else 0.0 for own, n, rest in self.sums_of(texts)], float)

    def sums_of(self, texts: list[str | None]) -> list[tuple[float, int, dict[str, int] | None]]:
        """For each text the sum of its words' leads, how many words it has, and, or None, the words that the
        tables tell, with how often they come; the sum leaves those out."""
        said = [words_of(t) for t in texts]
        first = 0
        while first < len(said):
            new: set[str] = set()
            if len(self.leads) > KEPT:
                self.leads.clear()
            stop = first
            while stop < len(said) and len(new) < HELD:  # all new words of many texts at once
                new.update(w for w in said[stop] if w not in self.leads)
                stop += 1
            if new:
                self.learn(sorted(new))
            for i in range(first, stop):
                own = list(map(self.leads.__getitem__, said[i]))
                total = float(sum(own))
                rest = Counter(w for w, x in zip(said[i], own) if x != x) if total != total else None
                said[i] = sum(x for x in own if x == x) if rest else total, len(own), rest
            first = stop
        return said


def counted_expressions(labelled: DataFrame) -> DataFrame:
    """A stored table (expression, toxic, ordinary): how often either class has each expression, from all rows of
    labelled (text, toxic)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words[int(toxic == 1)].update(words_of(text))
                if len(words[0]) + len(words[1]) > HELD:
                    yield frame(*words)
                    words = Counter(), Counter()
        if any(words):  # an empty column of texts would not convert
            yield frame(*words)

    def frame(*words: Counter) -> pd.DataFrame:
        found = Counter(), Counter()
        for own, counts in zip(words, found):
            for word, n in own.items():
                for e in expressions(word):
                    counts[e] += n
        both = list(found[0].keys() | found[1].keys())
        return pd.DataFrame({"expression": both, "toxic": [found[1][e] for e in both], "ordinary": [found[0][e] for e in both]})

    each = labelled.select("text", "toxic").mapInPandas(count, "expression string, toxic long, ordinary long")
    met = each.groupBy("expression").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    return written(met, "toxic-counts", TEXT_ROWS)


def _met(columns: list[str]) -> list[Column]:
    """How many rows have 1, 2, 3 and 4 in each column."""
    return [F.count(F.when(F.col(c) == k, 1)) for c in columns for k in (1, 2, 3, 4)]


def _off(n: Column, d: tuple[float, float, float]) -> Column:
    """What is discounted from a count."""
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)


def shared_steps(counts: DataFrame) -> tuple[DataFrame, int]:
    """The shared lower orders, and how many different characters there are. A stored table (lower, own, rest): the
    probability of the last character of ``lower`` after the others is own + rest times that of the next lower order."""
    length = F.length("expression")
    parts = F.transform(
        F.sequence(F.lit(1), length - 1),
        lambda k: F.struct(F.right("expression", k).alias("lower"), F.substring("expression", length - k, F.lit(1)).alias("before")),
    )
    pairs = counts.select(F.explode(parts).alias("x")).select("x.*").distinct()
    met = written(pairs.groupBy("lower").agg(F.count(F.lit(1)).alias("n")), "toxic-continued")
    by_length = met.groupBy(F.length("lower").alias("k")).agg(*_met(["n"]), F.count(F.lit(1)).alias("types")).collect()  # ORDER - 1 rows
    off = F.lit(0.0)
    for row in by_length:
        off = F.when(F.length("lower") == row["k"], _off(F.col("n"), discounts(*row[1:5]))).otherwise(off)
    after = F.left("lower", F.length("lower") - 1).alias("after")
    split = met.select("lower", after, F.col("n") - off, off.alias("off"), "n").toDF("lower", "after", "kept", "off", "n")
    sums = split.groupBy("after").agg(F.sum("n").alias("total"), F.sum("off").alias("saved"))
    steps = split.join(sums, "after").select("lower", (F.col("kept") / F.col("total")).alias("own"), (F.col("saved") / F.col("total")).alias("rest"))
    return written(steps, "toxic-shared"), max([r["types"] for r in by_length if r["k"] == 1], default=0)


def ratio_model(counts: DataFrame) -> RatioModel:
    """The model of a stored table of counted_expressions(). Without counts of both classes it knows nothing."""
    sums = [F.sum("toxic"), F.sum("ordinary")]
    totals = counts.agg(*sums, *_met(["toxic", "ordinary"])).first()
    if not totals[0] or not totals[1]:
        return RatioModel()
    d = {"toxic": discounts(*totals[2:6]), "ordinary": discounts(*totals[6:10])}
    share = totals[0] / (totals[0] + totals[1])
    likely = share * (F.col("toxic") + F.col("ordinary"))
    lean = (F.col("toxic") - likely) / F.sqrt(likely)
    entries, *passing = counts.agg(F.count(F.lit(1)), *[F.count(F.when(lean > z, 1)) for z in LEANS]).first()
    least = next((z for z, n in zip(LEANS, passing, strict=True) if n <= 2 / SHARE), math.inf)
    often = (F.col("toxic") > SHARE * totals[0]) | (F.col("ordinary") > SHARE * totals[1]) | (lean > least)
    whole = counts.where(often).count() == entries
    split = counts.select(
        "expression",
        F.left("expression", F.length("expression") - 1).alias("context"),
        often.alias("sent"),
        *d,
    )
    met = [F.count(F.when(F.col(c).between(k, k if k < 3 else 1 << 62), 1)) for c in d for k in (1, 2, 3)]
    names = [f"{c}_{k}" for c in d for k in (1, 2, 3)]
    contexts = split.groupBy("context").agg(
        F.max("sent").alias("any"), *[F.sum(c).alias(f"{c}_sum") for c in d], *[x.alias(n) for x, n in zip(met, names, strict=True)]
    )
    off = {c: sum((F.col(f"{c}_{k}") * d[c][k - 1] for k in (1, 2, 3)), F.lit(0.0)) for c in d}
    saved = [F.when(F.col(f"{c}_sum") > 0, off[c] / F.col(f"{c}_sum")).otherwise(1.0).alias(f"{c}_saved") for c in d]
    contexts = written(contexts.select("context", "any", *[f"{c}_sum" for c in d], *saved), "toxic-contexts")

    steps, symbols = shared_steps(counts)
    lower = split.select("expression", F.explode(F.sequence(F.lit(1), F.length("expression") - 1)).alias("k"))
    lower = lower.withColumn("lower", F.right("expression", F.col("k"))).join(steps, "lower")
    ladder = F.array_sort(F.collect_list(F.struct("k", "own", "rest")))
    shared = lower.groupBy("expression").agg(
        F.aggregate(ladder, F.lit(1.0 / (symbols + 1)), lambda p, x: x["own"] + x["rest"] * p).alias("shared")
    )
    own = {c: F.coalesce((F.col(c) - _off(F.col(c), d[c])) / F.nullif(F.col(f"{c}_sum"), F.lit(0)), F.lit(0.0)) for c in d}
    p = {c: own[c] + F.col(f"{c}_saved") * F.col("shared") for c in d}
    each = split.join(shared, "expression").join(contexts, "context")
    ratios = each.select("expression", F.log(p["toxic"] / p["ordinary"]).cast("float").alias("ratio"), "sent")
    ahead = contexts.select("context", F.log(F.col("toxic_saved") / F.col("ordinary_saved")).cast("float").alias("ahead"), "any")
    if whole:
        return RatioModel(_figures(ratios.drop("sent")), _figures(ahead.drop("any")))
    ratios, ahead = written(ratios, "toxic-ratios"), written(ahead, "toxic-ahead")
    sent = _figures(ratios.where("sent").drop("sent")), _figures(ahead.where("any").drop("any"))
    return RatioModel(*sent, tables=(ratios.drop("sent"), ahead.drop("any")), whole=False)


def _figures(table: DataFrame) -> Figures:
    """A table (text, number) for the driver: 12 bytes for each of at most 4 / SHARE rows, and as many contexts."""
    text, number = table.columns
    rows = table.select(F.xxhash64(quoted(text)).alias("key"), quoted(number).cast("float").alias("value")).toArrow()
    return Figures.of(rows.column("key").to_numpy(), rows.column("value").to_numpy())


def logistic(x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(factor, constant) of a regression on one number with a small penalty, by Newton's method."""
    scale, mean = x.std() or 1.0, x.mean()
    x = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    penalty = np.diag([1.0, 1e-3])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) + penalty @ beta
        step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p))[:, None]) + penalty, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta[0] / scale, beta[1] - beta[0] * mean / scale


def _logarithm(leads: np.ndarray) -> np.ndarray:
    """Of the leads and FLOOR together; below 0 it goes on in a straight line, so that no two leads become one."""
    above = np.maximum(leads, 0.0)
    return np.log(above + FLOOR) + np.minimum(leads, 0.0)


def _expressions(word: Column) -> Column:
    """expressions() of a word."""
    marked = F.concat(F.lit(" "), word, F.lit(" "))
    ends = F.sequence(F.lit(2), F.length(marked))
    return F.transform(ends, lambda i: F.substring(marked, F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))


def leads_by_joins(words: DataFrame, tables: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(key, lead) of words (key, word), from the tables of all expressions and contexts. Figures are added up in their order
    within the word."""
    ratios, ahead = tables
    each = words.select("key", F.posexplode(_expressions(F.col("word"))).alias("at", "expression"))
    each = each.withColumn("context", F.left("expression", F.length("expression") - 1))
    each = each.join(ratios, "expression", "left").join(ahead, "context", "left")
    found = F.coalesce(F.col("ratio"), F.col("ahead"), F.lit(0.0)).cast("double").alias("x")
    parts = F.array_sort(F.collect_list(F.struct("at", found)))
    summed = each.groupBy("key").agg(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["x"]).alias("ratio"))
    return summed.select("key", F.log1p(TOXIC_SHARE * F.expm1(F.least(F.col("ratio"), F.lit(30.0)))).alias("lead"))


def with_leads(docs: DataFrame, sent: Broadcast, tables: tuple[DataFrame, DataFrame] | None, text: str, output: str) -> DataFrame:
    """``docs`` with a new double ``output``: what each text's toxic log-likelihood is ahead for each word.

    Without ``tables`` the broadcast model is whole and texts are only read. With them, the words that it doesn't know whole
    are stored by text (two hashes of it, once for equal texts), joined with their leads and added up again by text.
    """
    content = F.coalesce(quoted(text), F.lit(""))
    if tables is None:

        @pandas_udf("double")
        def lead(texts: pd.Series) -> pd.Series:
            return pd.Series(sent.value.leads_of(texts.tolist()), dtype="float64")

        return docs.withColumn(output, lead(content))

    @pandas_udf("own double, words long, rest array<struct<word: string, n: long>>")
    def sums(texts: pd.Series) -> pd.DataFrame:
        found = sent.value.sums_of(texts.tolist())
        rest = [[{"word": w, "n": n} for w, n in sorted((x[2] or {}).items())] for x in found]
        return pd.DataFrame({"own": [float(x[0]) for x in found], "words": [x[1] for x in found], "rest": rest})

    one, two = (F.xxhash64(*salt, content) for salt in ((), (F.lit("two"),)))
    texts = docs.select(one.alias("one"), two.alias("two"), F.explode(sums(content)["rest"]).alias("x"))
    rests = written(texts.select("one", "two", F.xxhash64("x.word").alias("key"), "x.word", "x.n"), "toxic-rest", TEXT_ROWS)
    leads = if_small(written(leads_by_joins(rests.select("key", "word").distinct(), tables), "toxic-rest-leads"))
    joined = rests.select("one", "two", "key", "n").distinct().join(leads, "key")
    parts = F.array_sort(F.collect_list(F.struct("key", (F.col("n") * F.col("lead")).alias("x"))))
    told = joined.groupBy("one", "two").agg(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["x"]).alias("rest"))
    names = {n: fresh(docs, f"__{n}") for n in ("sums", "one", "two", "of_one", "of_two", "rest")}
    told = if_small(written(told, "toxic-rest-sums")).toDF(names["of_one"], names["of_two"], names["rest"])
    here = docs.withColumns({names["sums"]: sums(content), names["one"]: one, names["two"]: two})
    same = (F.col(names["one"]) == F.col(names["of_one"])) & (F.col(names["two"]) == F.col(names["of_two"]))
    own = F.col(names["sums"])
    lead = F.coalesce((own["own"] + F.coalesce(F.col(names["rest"]), F.lit(0.0))) / F.nullif(own["words"], F.lit(0)), F.lit(0.0))
    return here.join(told, same, "left").select(*[quoted(c) for c in docs.columns], lead.alias(output))


@dataclass
class ToxicityModel:
    """``sent``: a RatioModel, which has been broadcast and is known to all tasks until release(). ``tables``: those of the
    RatioModel, None if it is whole."""

    sent: Broadcast
    factor: float
    constant: float
    tables: tuple[DataFrame, DataFrame] | None = None

    def release(self) -> None:
        self.sent.destroy()


def id_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _labels_of(labels: DataFrame, folds: list[int]) -> DataFrame:
    """(doc_id, toxic) of the folds; an id counts once."""
    own = labels.where(F.col("toxic").isin(0, 1) & id_fold(F.col("doc_id")).isin(folds))
    return own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def labelled_documents(docs: DataFrame, labels: DataFrame, folds: list[int]) -> DataFrame:
    """(text, toxic) of all labelled documents in the folds; an id counts once. Only texts of repeated ids are moved
    while the labels are few."""
    own = if_small(written(_labels_of(labels, folds), "toxic-labels"))
    ids = docs.select("doc_id").join(own, "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = if_small(written(ids.where("n > 1").select("doc_id"), "toxic-repeated"))
    found = docs.select("doc_id", "text").join(own, "doc_id")
    several = _one_text(found.join(repeated, "doc_id", "left_semi"), "toxic")
    return found.join(repeated, "doc_id", "left_anti").select("text", "toxic").unionByName(several)


def _one_text(found: DataFrame, *more: str) -> DataFrame:
    """For each doc_id the text with the smallest hash, and what all its rows share."""
    first = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text"))
    return found.groupBy("doc_id").agg(first.alias("first"), *[F.max(c).alias(c) for c in more]).select("first.text", *more)


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: list[int]) -> DataFrame:
    """(text, toxic, weight) of at most SAMPLE documents of each class in the folds; an id counts once. weight:
    documents of the class for each that was taken."""
    own = _labels_of(labels, folds)
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = None
    for label, n in sorted(totals.items()):
        part = own.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        part = part.withColumn("weight", F.lit(n / min(n, SAMPLE)))
        taken = part if taken is None else taken.unionByName(part)
    if taken is None:
        taken = own.withColumn("weight", F.lit(1.0))
    taken = F.broadcast(written(taken, "toxic-sample"))  # at most 2 * SAMPLE rows of an id and two numbers
    return _one_text(docs.select("doc_id", "text").join(taken, "doc_id"), "toxic", "weight")


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, toxic). Labels of fold 0 are never read; all those of folds 2, 3 and 4 make
    the models of words, at most SAMPLE of each class in fold 1 the regression. Repeated ids count once, with the text
    of the smallest hash, repeated texts as often as they come. Without labels of both classes every score is 0."""
    model = ratio_model(counted_expressions(labelled_documents(docs, labels, [2, 3, 4])))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # some 50 MB for 2 / SHARE expressions and their contexts
    sample = with_leads(labelled_sample(docs, labels, [1]), broadcast, model.tables, "text", "x").select("x", "toxic", "weight")
    fitted = written(sample, "toxic-leads", TEXT_ROWS).toPandas()
    if fitted["toxic"].nunique() < 2:
        return ToxicityModel(broadcast, 0.0, -30.0, model.tables)
    x, toxic, weight = (fitted[c].to_numpy(float) for c in ("x", "toxic", "weight"))
    return ToxicityModel(broadcast, *logistic(_logarithm(x), toxic, weight), model.tables)


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with a double ``output``, which replaces one of that name; other columns stay, whatever their names.

    Null texts score as empty ones. Texts of any length count whole, and nothing but the text does: equal texts have
    equal scores. An empty table gives an empty one.
    """
    factor, constant = model.factor, model.constant

    @pandas_udf("double")
    def score(leads: pd.Series) -> pd.Series:
        x = _logarithm(leads.to_numpy(float))
        return pd.Series(1 / (1 + np.exp(-np.clip(x * factor + constant, -30, 30))), dtype="float64")

    held = fresh(docs, "__lead")
    scored = with_leads(docs, model.sent, model.tables, text, held)
    kept = [quoted(c) for c in docs.columns if c.lower() != output.lower()]
    return scored.select(*kept, score(quoted(held)).alias(output))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = written(toxicity(docs, model).select("doc_id", "score"), "toxic-scores", TEXT_ROWS)
    model.release()
    return scored.select(
        "doc_id",
        (id_fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
