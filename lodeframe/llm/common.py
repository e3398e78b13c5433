"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stored import scratch

#: ASCII white space, as the contents of a character class.
SPACE = r"\x20\x09-\x0D"
#: A word: a run of anything else.
WORD = rf"[^{SPACE}]+"


#: Rows in a batch to and from Python, where whole texts go there.
TEXT_ROWS = 2_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_batch_lock = threading.RLock()  # one at a time changes the setting, which all threads of a session share


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again; with ``batch``, in batches of so many rows at
    most wherever Python takes part.

    Cuts the lineage, so that a lost executor costs no more than its running tasks, and gives later joins the size of
    their inputs. The files go with functions.stored.release() or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if batch:
        with _batch_lock:
            before = spark.conf.get(BATCH)
            spark.conf.set(BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
            try:
                df.write.parquet(path)
            finally:
                spark.conf.set(BATCH, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that a broadcast may have.
BROADCAST_ROWS = 300_000


def if_small(stored: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most BROADCAST_ROWS rows; beyond, Spark joins by shuffle."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's discounts for counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    pairs = ((1, n1, n2), (2, n2, n3), (3, n3, n4))
    return tuple(min(k, max(0.1, k - (k + 1) * y * b / a)) if a else 0.5 * k for k, a, b in pairs)


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Elements of arrays that are gone through together, so that n of them take n * BLOCK steps, not n * n.
BLOCK = 256


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the value, which is worked out once even if lambdas use it for each of their elements."""
    return F.get(F.transform(F.array(value), of), 0)


def blocks(items: Column, of: Callable[[Column, Column], Column], seen: int = 0) -> Column:
    """``of`` each block of an array and the elements before it, ``seen`` at most. An empty array is one empty block."""

    def each(i: Column) -> Column:
        first = i * BLOCK
        return of(F.slice(items, first + 1, F.lit(BLOCK)), F.slice(items, F.greatest(first + 1 - seen, F.lit(1)), F.least(first, F.lit(seen))))

    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), each)


def sums_before(numbers: Column) -> Column:
    """For each of an array of longs the sum of those before it, and at the end that of all; added up by blocks."""

    def running(items: Column, first: Column) -> Column:
        return F.aggregate(items, F.array(first), lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + x)))

    zero = F.lit(0).cast("long")
    total = lambda own, _: F.aggregate(own, zero, lambda n, x: n + x)
    inner = lambda n: let(
        running(blocks(n, total), zero),
        lambda starts: let(
            blocks(n, lambda own, _: own),
            lambda parts: F.concat(
                F.flatten(F.transform(parts, lambda own, i: F.slice(running(own, F.get(starts, i)), 1, F.size(own)))),
                F.array(F.element_at(starts, -1)),
            ),
        ),
    )
    return let(numbers, inner)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, such that no column of ``df`` is called so (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine; executors call it themselves."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def surviving(docs: DataFrame, keys: dict[str, Column], verdicts: DataFrame, id_column: str, prefer: list[Column]) -> DataFrame:
    """Rows of ``docs`` under its own columns, without those that ``verdicts`` drops.

    ``keys`` gives, by name, expressions over ``docs`` that with the id name a row; ``verdicts`` (those names, doc_id,
    kept) has a row for each row of ``docs``. Rows that share all keys are settled together: if any of them is kept,
    the first by ``prefer`` stays. Only what is dropped or shared is joined, by broadcast if that is small.
    """
    of = {n: fresh(docs, f"__of_{n}") for n in (*keys, "doc_id", "kept", "place")}
    own = {n: fresh(docs, f"__own_{n}") for n in keys}
    settled = verdicts.groupBy(*keys, "doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    settled = settled.where(~F.col("kept") | (F.col("rows") > 1)).drop("rows")
    settled = written(settled, "verdicts").withColumnsRenamed({n: of[n] for n in (*keys, "doc_id", "kept")})
    small = settled.count() <= BROADCAST_ROWS
    sent = lambda table: F.broadcast(table) if small else table
    keyed = docs.withColumns({own[n]: x for n, x in keys.items()})
    match = quoted(id_column).eqNullSafe(F.col(of["doc_id"]))
    for n in keys:
        match = match & (F.col(own[n]) == F.col(of[n]))
    single = keyed.join(sent(settled), match, "left_anti")
    shared = Window.partitionBy(*own.values(), quoted(id_column)).orderBy(*prefer)
    several = keyed.join(sent(settled.where(F.col(of["kept"]))), match, "left_semi")
    several = several.withColumn(of["place"], F.row_number().over(shared)).where(F.col(of["place"]) == 1)
    columns = [quoted(c) for c in docs.columns]
    return single.select(*columns).unionByName(several.select(*columns))
