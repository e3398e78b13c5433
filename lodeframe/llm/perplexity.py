"""Perplexity of documents under an interpolated modified Kneser-Ney model of the characters of trusted text.

The model is one of 4-grams of the characters themselves, of any script, and grows with the trusted text: all orders are stored
tables, joined with the different 4-grams of the documents that are judged. What a 4-gram is worth is sent to where the texts are,
the most frequent ``SENT`` of them; texts with others get the rest by a join, so that none is left out or approximated.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from xxhash import xxh64_intdigest

from .common import TEXT_ROWS, discounts, fresh, if_small, quoted, written
from .quality import HELD_OUT, limits_of, verdicts
from .toxicity import Figures

ORDER = 4
#: Stands before a text's first character; no character of any script.
START = "\ufdd0"
#: Characters whose 4-grams are told apart at once, some 90 bytes each; parts of longer texts have as many, so that no more than
#: twice as many come together.
CHUNK = 500_000
#: Different 4-grams that a Python worker counts before it passes them on.
HELD = 300_000
#: 4-grams that are sent to all tasks, 12 bytes each.
SENT = 2_000_000


def indexed(parts: list[str]) -> tuple[list[str], np.ndarray]:
    """The different 4-grams of parts of texts, each after the three characters before it, and for each character of the parts the
    place of the 4-gram that ends there."""
    joined = "".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    alphabet = np.zeros(0x110000, bool)
    alphabet[points] = True
    symbols = np.cumsum(alphabet, dtype=np.int64)[points] - 1
    base = int(alphabet.sum())
    pairs = symbols[:-1] * base + symbols[1:]
    if base**ORDER >= 1 << 63:
        pairs = np.unique(pairs, return_inverse=True)[1]
        base = int(pairs.max()) + 1
    else:
        base *= base
    codes = pairs[:-2] * base + pairs[2:]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) - (ORDER - 1)
    ends = np.repeat(np.arange(1, len(parts) + 1) * (ORDER - 1), lengths) + np.arange(lengths.sum())
    found, of = np.unique(codes[ends - (ORDER - 1)], return_inverse=True)
    some = np.empty(len(found), np.int64)
    some[of] = ends
    return [joined[i - ORDER + 1 : i + 1] for i in some.tolist()], of


def _chunks(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(place of the text, part for indexed()), many at once. Parts end where the text alone says, so that equal texts have equal
    ones; null and empty texts have none."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        padded = START * (ORDER - 1) + (text or "")
        for at in range(0, len(padded) - (ORDER - 1), CHUNK):
            held.append((i, padded[at : at + CHUNK + ORDER - 1]))
            size += len(held[-1][1]) - (ORDER - 1)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def counted_grams(docs: DataFrame, text: Column) -> DataFrame:
    """A stored table (gram, n) of all 4-grams of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: Counter = Counter()
        for batch in batches:
            for parts in _chunks(batch["text"].tolist()):
                grams, of = indexed([part for _, part in parts])
                met.update(dict(zip(grams, np.bincount(of).tolist(), strict=True)))
                if len(met) > HELD:
                    yield pd.DataFrame({"gram": list(met), "n": list(met.values())})
                    met = Counter()
        if met:
            yield pd.DataFrame({"gram": list(met), "n": list(met.values())})

    each = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInPandas(count, "gram string, n long")
    return written(each.groupBy("gram").agg(F.sum("n").alias("n")), "quality-grams", TEXT_ROWS)


@dataclass
class CharacterModel:
    """own: a stored table (gram, own) of the grams of each order, what their own counts give the last character after the
    others. rest: (context, rest), the part that goes to the next lower order. symbols: how many characters there are. limits:
    for each language (mean, threshold); under None those of all."""

    own: DataFrame | None
    rest: DataFrame | None
    symbols: int
    limits: dict


def model_of(counts: DataFrame) -> CharacterModel:
    """The model of a stored table of counted_grams(). Lower orders count the different characters that go before; each order has
    discounts for counts of 1, 2 and more by Chen and Goodman's estimates; the lowest interpolates with the uniform one over all
    characters and an unknown one."""
    parts = F.transform(
        F.sequence(F.lit(1), F.lit(ORDER - 1)),
        lambda k: F.struct(F.right("gram", k).alias("gram"), F.substring("gram", ORDER - k, F.lit(1)).alias("before")),
    )
    lower = counts.select(F.explode(parts).alias("x")).select("x.*").distinct().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    levels = written(counts.select("gram", "n").unionByName(lower), "quality-levels")
    met = [F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]
    by_length = levels.groupBy(F.length("gram").alias("k")).agg(*met, F.count(F.lit(1)).alias("types")).collect()  # ORDER rows
    off = F.lit(0.0)
    for row in by_length:
        d = discounts(*row[1:5])
        own_off = F.when(F.col("n") >= 3, d[2]).when(F.col("n") == 2, d[1]).otherwise(d[0])
        off = F.when(F.length("gram") == row["k"], own_off).otherwise(off)
    split = levels.select("gram", F.left("gram", F.length("gram") - 1).alias("context"), (F.col("n") - off).alias("kept"), off.alias("off"), "n")
    sums = written(split.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("rest")), "quality-rests")
    own = split.join(sums, "context").select("gram", (F.col("kept") / F.col("total")).alias("own"))
    symbols = max([r["types"] for r in by_length if r["k"] == 1], default=0)
    return CharacterModel(written(own, "quality-own"), sums.select("context", "rest"), symbols, {})


def log_p(grams: DataFrame, model: CharacterModel) -> DataFrame:
    """(gram, n) as a stored table (key, n, value): the natural logarithm of the probability of the last character."""
    found = grams.withColumn("p", F.lit(1.0 / (model.symbols + 1)))
    for k in range(1, ORDER + 1) if model.own is not None else ():
        own = if_small(model.own.where(F.length("gram") == k)).withColumnRenamed("gram", "lower")
        rest = if_small(model.rest.where(F.length("context") == k - 1))
        found = found.withColumn("lower", F.right("gram", F.lit(k))).withColumn("context", F.left("lower", F.lit(k - 1)))
        found = found.join(own, "lower", "left").join(rest, "context", "left")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("p")
        found = found.select("gram", "n", p.alias("p"))
    return written(found.select(F.xxhash64("gram").alias("key"), "n", F.log("p").cast("float").alias("value")), "quality-values")


def with_sums(docs: DataFrame, model: CharacterModel, text: str, n: str, total: str) -> DataFrame:
    """``docs`` with the new columns n (characters) and total (sum of their log-probabilities)."""
    content = F.coalesce(quoted(text), F.lit(""))
    values = log_p(counted_grams(docs, content), model)
    whole = values.count() <= SENT
    rows = (values if whole else values.orderBy(F.desc("n"), "key").limit(SENT)).select("key", "value").toArrow()
    figures = docs.sparkSession.sparkContext.broadcast(Figures.of(rows.column("key").to_numpy(), rows.column("value").to_numpy()))

    @pandas_udf("n long, total double, rest array<struct<key: long, n: long>>")
    def sums(texts: pd.Series) -> pd.DataFrame:
        count, sums_of, rests = [0] * len(texts), [0.0] * len(texts), [Counter() for _ in texts]
        for parts in _chunks(texts.tolist()):
            grams, of = indexed([part for _, part in parts])
            keys = np.array([xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams], np.uint64)
            there, value = figures.value.get(keys)
            first = 0
            for i, part in parts:
                own = of[first : first + len(part) - (ORDER - 1)]
                first += len(own)
                count[i] += len(own)
                sums_of[i] += float(value[own].sum())
                if not whole and not there[own].all():
                    places, times = np.unique(own[~there[own]], return_counts=True)
                    rests[i].update(dict(zip(keys[places].view(np.int64).tolist(), times.tolist(), strict=True)))
        rest = [[{"key": k, "n": times} for k, times in own.items()] for own in rests]
        return pd.DataFrame({"n": count, "total": sums_of, "rest": rest})

    held = fresh(docs, "__sums")
    told = docs.withColumn(held, sums(content))
    own = F.col(held)
    columns = [quoted(c) for c in docs.columns]
    if whole:
        return told.select(*columns, own["n"].alias(n), own["total"].alias(total))
    one, two = (F.xxhash64(*salt, content) for salt in ((), (F.lit("two"),)))
    rests = docs.select(one.alias("one"), two.alias("two"), F.explode(sums(content)["rest"]).alias("x")).select("one", "two", "x.*")
    rests = written(rests.distinct(), "quality-rest", TEXT_ROWS).join(values.select("key", "value"), "key")
    parts = F.array_sort(F.collect_list(F.struct("key", (F.col("n") * F.col("value").cast("double")).alias("x"))))
    more = rests.groupBy("one", "two").agg(F.aggregate(parts, F.lit(0.0), lambda at, x: at + x["x"]).alias("more"))
    names = {c: fresh(docs, f"__{c}") for c in ("one", "two", "of_one", "of_two", "more")}
    more = if_small(written(more, "quality-rest-sums")).toDF(names["of_one"], names["of_two"], names["more"])
    same = (F.col(names["one"]) == F.col(names["of_one"])) & (F.col(names["two"]) == F.col(names["of_two"]))
    joined = told.withColumns({names["one"]: one, names["two"]: two}).join(more, same, "left")
    return joined.select(*columns, own["n"].alias(n), (own["total"] + F.coalesce(F.col(names["more"]), F.lit(0.0))).alias(total))


def train_characters(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> CharacterModel:
    """Trusted text as in quality.train(): all documents that ``labels`` (doc_id, quality) gives quality 1; a third of the texts,
    by hash, gives the thresholds, all others the counts."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__id")).distinct()
    columns = [quoted(id_column).alias("__doc"), quoted(text).alias("text"), quoted(lang).cast("string").alias("lang")]
    good = if_small(written(good, "quality-good"))
    trusted = docs.select(*columns).join(good, F.col("__doc") == F.col("__id"), "left_semi")
    held_out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    counts = counted_grams(trusted.where(~held_out), F.col("text"))
    if counts.isEmpty():
        return CharacterModel(None, None, 0, {})
    model = model_of(counts)
    sums = with_sums(trusted.where(held_out), model, "text", "n", "total").select("lang", "n", "total")
    model.limits = limits_of(written(sums, "quality-trusted", TEXT_ROWS))
    return model


def character_quality(docs: DataFrame, model: CharacterModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """As quality.quality(), by the perplexity of the characters themselves."""
    n, total = fresh(docs, "__n"), fresh(docs, "__total")
    return verdicts(with_sums(docs, model, text, n, total), docs.columns, n, total, model.limits, lang)
