"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of character 4-grams over 32 symbols, so that it has 32**4 entries at most, whatever the corpus: that
is a proven bound for what is broadcast. The counts come from all trusted documents; each task adds up its own and the
sums meet by n-gram. A document's perplexity, shrunk a little towards its language's mean so that a short text isn't
judged by a few letters, is held against a quantile of the trusted documents in its language.

``sharded_perplexity`` gives the same figures by joining each document's n-gram counts to the model's shard by shard. It has to
write a row for each document and distinct n-gram, several times the bytes of the documents.

This model folds letters into 32 symbols. The queries have the one of ``perplexity.py``, of the characters themselves, with the
thresholds and verdicts of this module.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import TEXT_ROWS, discounts, fresh, if_small, quoted, written

ORDER = 4
SYMBOLS = 32
SIZE = SYMBOLS**ORDER
#: The largest share of a language's trusted documents that may lie above its threshold, and what the threshold adds.
QUANTILE, SLACK = 0.995, 1.1
#: A text counts as if it had so many more characters of its language's mean.
SHRINK = 60
#: One of so many trusted texts, by hash, is left out of the counts; thresholds come from these alone.
HELD_OUT = 3
#: Such documents that a language needs for a threshold of its own; with fewer, that of all languages holds.
ENOUGH = 20


def _symbol(c: str) -> int:
    """Start 0, letters 1-26 (without accents; those of other scripts by code point), then capital, digit, space, common
    punctuation and all else."""
    if c.isspace():
        return 29
    if c.isupper():
        return 27
    if c.isalpha():
        base = unicodedata.normalize("NFD", c)[0].lower()
        return ord(base) - 96 if "a" <= base <= "z" else 1 + ord(c) % 26
    if c.isdigit():
        return 28
    return 30 if c in ".,;:'\"-?()" else 31


_symbols = np.array([_symbol(chr(c)) for c in range(0x250)], dtype=np.uint8)


def symbols(text: str | None) -> np.ndarray:
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known = points < len(_symbols)
    out = _symbols[np.where(known, points, 0)]
    if not known.all():
        out[~known] = [_symbol(chr(c)) for c in points[~known]]
    return out


def grams(text: str | None) -> np.ndarray:
    """The 4-gram that ends at each character, as a number."""
    s = np.concatenate([np.zeros(ORDER - 1, dtype=np.int32), symbols(text).astype(np.int32)])
    n = len(s) - ORDER + 1
    code = s[:n].copy()
    for k in range(1, ORDER):
        code = code * SYMBOLS + s[k : k + n]
    return code


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probability of each 4-gram's last symbol after its first three, from counts of 4-grams.

    Lower orders count the symbols that go before; each order has discounts for counts of 1, 2 and more, by Chen and
    Goodman's estimates, and gives what they save to the order below; the lowest interpolates with the uniform one.
    """
    levels = [counts.astype(np.float64).reshape(-1, SYMBOLS)]
    for order in range(ORDER - 1, 0, -1):
        seen = (levels[-1] > 0).reshape(SYMBOLS, -1)
        levels.append(seen.sum(axis=0).astype(np.float64).reshape(-1, SYMBOLS))
    p = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    for level in reversed(levels):
        d = discounts(*((level == k).sum() for k in (1, 2, 3, 4)))
        off = np.where(level >= 3, d[2], np.where(level == 2, d[1], np.where(level == 1, d[0], 0.0)))
        total = level.sum(axis=1, keepdims=True)
        safe = np.where(total > 0, total, 1.0)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(level) // len(p.reshape(-1, SYMBOLS)), 1))
        p = np.where(total > 0, (level - off) / safe + off.sum(axis=1, keepdims=True) / safe * lower, lower)
    return np.log(p).reshape(-1).astype(np.float32)


def trusted_counts(trusted: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts of ``trusted``: at most 32**4 rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(SIZE, dtype=np.int64)
        for batch in batches:
            for t in batch[text]:
                np.add.at(held, grams(t), 1)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"gram": at.astype(np.int32), "n": held[at]})

    each = trusted.select(quoted(text).alias(text)).mapInPandas(count, "gram int, n long")
    return each.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class QualityModel:
    """log_p: of all 4-grams. limits: for each language (mean, threshold); under None those of all."""

    log_p: np.ndarray
    limits: dict

    def sums(self, text: str | None) -> tuple[int, float]:
        g = grams(text)
        return len(g), float(self.log_p[g].sum(dtype=np.float64))


def _perplexity(n: Column, total: Column, mean: Column) -> Column:
    return F.exp(-(total + mean * SHRINK) / (n + SHRINK))


def log_sums(docs: DataFrame, log_p: np.ndarray, text: str, n: str, total: str) -> DataFrame:
    """``docs`` with the columns n (characters) and total (sum of their log-probabilities)."""
    broadcast = docs.sparkSession.sparkContext.broadcast(log_p)  # 4 MB

    @pandas_udf("n long, total double")
    def score(texts: pd.Series) -> pd.DataFrame:
        model = QualityModel(broadcast.value, {})
        return pd.DataFrame([model.sums(t) for t in texts], columns=["n", "total"])

    held = fresh(docs, "__quality")
    scored = docs.withColumn(held, score(F.coalesce(quoted(text), F.lit(""))))
    return scored.withColumns({n: F.col(held)["n"], total: F.col(held)["total"]}).drop(held)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id") -> QualityModel:
    """Trusted text: the documents that ``labels`` (doc_id, quality) gives quality 1, all of them. Some give the
    thresholds, all others the counts; a repeated id or text counts as often as it comes."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("__id")).distinct()
    columns = [quoted(id_column).alias("__doc"), quoted(text).alias("text"), quoted(lang).cast("string").alias("lang")]
    good = if_small(written(good, "quality-good"))
    trusted = docs.select(*columns).join(good, F.col("__doc") == F.col("__id"), "left_semi")
    held_out = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0  # by text, so that copies stay on one side
    counts = np.zeros(SIZE, dtype=np.int64)
    found = trusted_counts(trusted.where(~held_out | F.col("text").isNull())).toPandas()  # at most 32**4 rows
    counts[found["gram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    log_p = kneser_ney(counts)
    if not len(found):
        return QualityModel(log_p, {})
    others = log_sums(trusted.where(held_out), log_p, "text", "n", "total").select("lang", "n", "total")
    return QualityModel(log_p, limits_of(written(others, "quality-trusted", TEXT_ROWS)))


def limits_of(sums: DataFrame) -> dict:
    """For each language (mean, threshold), under None those of all, from a stored table (lang, n, total) of trusted documents."""
    means = sums.groupBy("lang").agg((F.sum("total") / F.sum("n")).alias("mean"))
    with_mean = sums.where("n > 0").join(F.broadcast(written(means, "quality-means").withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of")))
    ppl = with_mean.withColumn("ppl", _perplexity(F.col("n"), F.col("total"), F.col("mean")))
    limits: dict = {}
    quantile = (F.percentile_approx("ppl", F.lit(QUANTILE), F.lit(100_000)) * SLACK).alias("threshold")
    for row in ppl.groupBy("lang").agg(F.first("mean").alias("mean"), quantile, F.count(F.lit(1)).alias("rows")).collect():
        if row["rows"] >= ENOUGH and row["lang"] is not None:
            limits[row["lang"]] = row["mean"], row["threshold"]
    overall = ppl.agg((F.sum("total") / F.sum("n")).alias("mean"), quantile).first()
    if overall["threshold"] is not None:  # else too few trusted texts to hold any out
        limits[None] = overall["mean"], overall["threshold"]
    return limits


def quality(docs: DataFrame, model: QualityModel, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with perplexity, threshold and accepted, which replace columns of these names.

    Null texts are empty; a text without characters has its language's mean perplexity and is accepted. Null and
    unknown languages are held to the figures of all. A model without trusted text accepts everything. Texts of any
    length count whole; equal texts of one language get one verdict, in repeated rows as well; an empty table gives an
    empty one. Other columns stay, whatever their names.
    """
    n, total = fresh(docs, "__n"), fresh(docs, "__total")
    return verdicts(log_sums(docs, model.log_p, text, n, total), docs.columns, n, total, model.limits, lang)


def verdicts(scored: DataFrame, columns: list[str], n: str, total: str, limits: dict, lang: str) -> DataFrame:
    """``columns`` of ``scored`` with perplexity, threshold and accepted, from its columns n and total."""
    docs_columns = [quoted(c) for c in columns if c.lower() not in ("perplexity", "threshold", "accepted")]
    mean, limit = F.lit(0.0), F.lit(float("inf"))
    if limits:
        mean, limit = (F.lit(float(x)) for x in limits[None])
        own = {k: v for k, v in sorted((k, v) for k, v in limits.items() if k is not None)}
        if own:
            language = quoted(lang).cast("string")
            of = lambda i: F.map_from_arrays(F.array(*[F.lit(k) for k in own]), F.array(*[F.lit(float(v[i])) for v in own.values()]))
            mean, limit = (F.coalesce(F.try_element_at(of(i), language), x) for i, x in enumerate((mean, limit)))
    ppl = _perplexity(F.col(n), F.col(total), mean)
    return scored.select(
        *docs_columns, ppl.alias("perplexity"), limit.alias("threshold"), (ppl <= limit).alias("accepted")
    )


def sharded_perplexity(docs: DataFrame, log_p: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n and total as in log_sums(), by a join of each document's 4-gram counts with log_p (gram, log_p). For
    models of any size; documents with equal ids are added up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, t in zip(batch["doc_id"], batch["text"]):
                gram, n = np.unique(grams(t), return_counts=True)
                yield pd.DataFrame({"doc_id": doc_id, "gram": gram, "n": n})

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(quoted(id_column).alias("doc_id"), quoted(text).alias("text"))
    each = rows.mapInPandas(count, f"doc_id {kind}, gram int, n long")
    joined = each.join(log_p, "gram")
    return joined.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("log_p")).alias("total"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    from .perplexity import character_quality, train_characters

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train_characters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = character_quality(docs, model).select("doc_id", "lang", "perplexity", "threshold", "accepted")
    return written(judged, "quality-judged", TEXT_ROWS)
