"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. For each of ``SAMPLES`` samples every term draws, from a
hash of the term and the sample's number, r and c from the Gamma(2, 1) distribution and b from the uniform one. With its
weight S, t = floor(ln S / r + b) and ln a = ln c - r (t - b + 1); the term with the least a wins, and (term, t) is the
sample. Two texts agree in a sample with a probability that is their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger ones.

The draws come from tables of quantiles, and a, rounded to 2**-32, makes one long with 24 bits that stand for (term, t),
so that all samples of a text are plain minima over its terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, partitions, quoted, written

#: Samples in a fingerprint; the likeness of two has a standard error of at most 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 64
#: Entries in the tables of quantiles, a power of two.
LEVELS = 4096
#: Buckets of neighbouring ids for each shuffle partition.
BUCKETS = 4


def gamma_quantiles(spark: SparkSession, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """An array of LEVELS quantiles x of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), at the middles
    of equal parts, or of what ``of`` makes of them. A scalar subquery, so that plans hold no table."""

    def quantile(i: Column) -> Column:
        p = (i + 0.5) / LEVELS

        def halved(bounds: Column, _: Column) -> Column:
            middle = (bounds["low"] + bounds["high"]) / 2
            below = 1 - (1 + middle) * F.exp(-middle) < p
            return F.struct(
                F.when(below, middle).otherwise(bounds["low"]).alias("low"),
                F.when(below, bounds["high"]).otherwise(middle).alias("high"),
            )

        start = F.struct(F.lit(0.0).alias("low"), F.lit(50.0).alias("high"))
        return of(F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halved, lambda bounds: bounds["low"]))

    numbers = F.sequence(F.col("id"), F.col("id") + LEVELS - 1)  # of a column, or the optimizer would fold the table in
    return spark.range(0, 1, 1, 1).select(F.transform(numbers, quantile)).scalar()


def sample_minima(samples: int = SAMPLES) -> list[Column]:
    """Aggregates over the terms of a text (term, log_weight, and the tables r_of and log_c_of), one for
    each sample: longs whose lower 24 bits stand for the winner."""
    bits = int(math.log2(LEVELS))
    out = []
    for j in range(samples):
        x = F.xxhash64(F.col("term"), F.lit(j))
        r = F.get("r_of", x.bitwiseAND(LEVELS - 1).cast("int"))
        log_c = F.get("log_c_of", F.shiftrightunsigned(x, bits).bitwiseAND(LEVELS - 1).cast("int"))
        b = F.shiftrightunsigned(x, 2 * bits).cast("double") / float(1 << (64 - 2 * bits))
        t = F.floor(F.col("log_weight") / r + b)
        log_a = log_c - r * (t - b + 1)
        winner = (F.shiftrightunsigned(x, 2 * bits).bitwiseAND((1 << 31) - 1) + t * 40503).bitwiseAND((1 << 24) - 1)
        # a weight is below 2**62, so that ln a lies between -64 and 64
        out.append(F.min(F.shiftleft(F.floor((log_a + 64) * float(1 << 32)), 24).bitwiseOR(winner)).alias(f"s{j}"))
    return out


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and signature (array<smallint>, null for a text without words), from texts (keys, text). No shuffle if
    ``texts`` is already dealt by some of the keys."""
    words = texts.select(*keys, F.explode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    terms = words.select(*keys, F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"))
    weighted = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("weight"))
    drawn = weighted.select(
        *keys,
        "term",
        F.when(F.col("term").isNotNull(), F.log(F.col("weight").cast("double"))).alias("log_weight"),
        gamma_quantiles(texts.sparkSession).alias("r_of"),
        gamma_quantiles(texts.sparkSession, F.log).alias("log_c_of"),
    )
    minima = drawn.groupBy(*keys).agg(*sample_minima(samples))
    # a smallint of the 16 lowest bits of each winner
    low = [(F.col(f"s{j}").bitwiseAND(0xFFFF) - 0x8000).cast("smallint") for j in range(samples)]
    return minima.select(*keys, F.when(F.col("s0").isNotNull(), F.array(*low)).alias("signature"))


def fingerprint_text(signature: Column) -> Column:
    """Four hexadecimal digits for each sample; empty for a text without words."""
    digits = F.transform(signature, lambda x: F.lpad(F.hex(x.cast("int") + 0x8000), 4, "0"))
    return F.coalesce(F.lower(F.array_join(digits, "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two signatures have in common; of texts without words, 1 with each other, else 0."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def bucketed(rows: DataFrame, order: str, tie: str, bucket: str) -> DataFrame:
    """``rows`` with a bucket number that grows with the columns ``order`` and ``tie`` (longs): about as many rows in
    each of BUCKETS buckets for a shuffle partition. An order that fills buckets by itself, and null, which comes first, are
    dealt by equal ranges of the tie; only rows equal in both can't be told apart."""
    n = partitions(rows.sparkSession) * BUCKETS
    shares = F.lit(np.arange(1, n) / n)
    found = rows.agg(F.percentile_approx(order, shares, 100 * n).alias("b")).first()["b"] or []
    bounds, times = np.unique(np.array(found, dtype=np.int64), return_counts=True)
    below, crowded = F.lit(0), F.lit(False)
    if len(bounds):
        table, steps = F.lit(bounds), [1 << k for k in reversed(range(len(bounds).bit_length()))]
        below = F.aggregate(  # the number of bounds below, by bisection
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) < F.col(order)), at + step).otherwise(at),
        )
        crowded = F.array_contains(F.lit(bounds[times > 1]), F.col(order)) if (times > 1).any() else crowded
    missing = F.col(order).isNull()
    part = F.floor((F.col(tie) / float(1 << 64) + 0.5) * n).cast("long")
    held = F.greatest(F.least(part, F.lit(n - 1).cast("long")), F.lit(0).cast("long"))
    at = F.when(missing, -1).when(crowded, below * 2 + 1).otherwise(below * 2).cast("long")
    return rows.withColumn(bucket, at * n + F.when(missing | crowded, held).otherwise(0))


def first_of_next(firsts: DataFrame, column: str) -> DataFrame:
    """(of, after): for each bucket what the next one begins with, and the first one after the last. firsts: a stored
    row for each bucket that has rows (bucket, column). Only bucket numbers, at most one for each range of ids, are put in
    order in one task; what buckets begin with is joined to them."""
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    following = F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy(F.lit(0))))
    numbers = firsts.select(F.col("bucket").alias("of"), following.alias("following"))
    return numbers.join(firsts, F.col("following") == F.col("bucket")).select("of", F.col(column).alias("after"))


def edited_neighbours(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """bucket, place, doc_id, text (null is empty) and edited: the text whose last floor(n / 4) of n code points are
    replaced by the first as many (or all) of the next document by id; the first follows the last. Null ids come first;
    equal ids go by a hash of their texts, and a document alone is its own next. Ids have to be whole numbers; others that
    don't cast to long raise. Dealt by bucket; texts are shuffled once, whatever their length. Empty tables give empty ones."""
    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows = bucketed(rows.withColumn("tie", F.xxhash64("text")), "doc_id", "tie", "bucket")
    n = partitions(docs.sparkSession) * BUCKETS
    firsts = written(rows.groupBy("bucket").agg(F.min_by("text", F.struct("doc_id", "tie")).alias("text")), "fingerprint-firsts")
    after = written(first_of_next(firsts, "text"), "fingerprint-after")
    own = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    dealt = rows.repartition(n, "bucket").select(
        "bucket", "doc_id", "text", F.row_number().over(own).alias("place"), F.lead("text").over(own).alias("next")
    )
    joined = dealt.join(after.hint("merge"), F.col("bucket") == F.col("of"), "left")
    part = F.floor(F.length("text") / 4).cast("int")
    return joined.select(
        "bucket",
        "place",
        "doc_id",
        "text",
        F.concat(F.left("text", F.length("text") - part), F.left(F.coalesce("next", "after"), part)).alias("edited"),
    )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and signature of each row's text, null for texts without words, null texts among them. Equal texts have
    equal signatures whatever their ids and other columns; a very long text is one weighted set of words like any other,
    added up by word. Repeated rows and ids stand for themselves; empty tables give empty ones."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        quoted(id_column).alias("doc_id"),
        F.coalesce(quoted(text), F.lit("")).alias("text"),
    )
    dealt = rows.repartition(partitions(docs.sparkSession) * BUCKETS, "uid")
    return signatures(dealt, ["uid", "doc_id"]).drop("uid")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = edited_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    both = docs.select(
        "bucket",
        "place",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")),
            )
        ).alias("v"),
    ).select("bucket", "place", "v.which", "v.text")
    signed = signatures(both, ["bucket", "place", "which"])
    pick = lambda k: F.first(F.when(F.col("which") == k, F.col("signature")), ignorenulls=True)
    pairs = signed.groupBy("bucket", "place").agg(pick(0).alias("own"), pick(1).alias("changed"))
    plain = docs.select(
        "bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    )
    rows = written(plain.join(pairs.hint("merge"), ["bucket", "place"]), "fingerprints")
    firsts = written(rows.where("place = 1").select("bucket", F.struct("own").alias("own")), "fingerprint-first-own")
    after = first_of_next(firsts, "own")
    following = F.lead(F.struct("own")).over(Window.partitionBy("bucket").orderBy("place"))
    with_next = rows.withColumn("next", following).join(after, F.col("bucket") == F.col("of"), "left")
    next_own = F.coalesce("next", "after")["own"]
    return with_next.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), next_own).alias("near_next"),
    )
