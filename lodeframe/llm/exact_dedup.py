"""Exact dedup by digest, with frequent digests split off.

A Misra-Gries summary (Spark's frequent-items sketch, whose counters merge across tasks) names the digests that may be
frequent. Their exact counts and winners, at most ``MOST_FREQUENT`` of them, are broadcast, and their rows are settled
where they are. All other digests have few rows each and are settled by an ordinary shuffle. Only ids, lengths and
digests move; texts stay with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, surviving, written

#: Digests that are broadcast at most, and counters of the summary: a digest with more than 1/COUNTERS of the rows is
#: among them for certain. Rarer ones that the summary misses take the shuffle, so that no bound drops any.
MOST_FREQUENT = 1_000
COUNTERS = 16_384


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "\x20\x09\x0a\x0b\x0c\x0d", "")


def text_digest(text: Column) -> Column:
    return F.sha2(squeezed(text).cast("binary"), 256)


def frequent_digests(rows: DataFrame, digest: str) -> DataFrame:
    """Candidates for frequent digests with exact counts over 100, at most MOST_FREQUENT rows."""
    top = rows.agg(F.expr(f"approx_top_k({digest}, {MOST_FREQUENT}, {COUNTERS})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).select(
        F.col("t.item").alias(digest), F.col("t.count").alias("about")
    )
    return candidates.where((F.col("about") > 100) & F.col(digest).isNotNull()).select(digest)


def exact_groups(rows: DataFrame) -> DataFrame:
    """rows (uid, doc_id, length, digest; a stored table, uid unique) with keep_id, group_size and kept.

    Of each digest the longest text stays, then the smallest doc_id (a null one last), then the smallest uid: rows that
    repeat in full leave one. Null and empty texts and those of white space are one group. A text of any length is one
    digest here; a group of any size is settled without bringing it together if its digest is frequent. An empty table
    gives an empty one. Other columns of ``rows`` are not read, whatever their names.
    """
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("n"), "doc_id", "uid"))
    candidates = written(frequent_digests(rows, "digest"), "dedup-frequent")
    verified = (
        rows.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    )
    winners = F.broadcast(written(verified, "dedup-winners"))  # a row for each candidate at most
    frequent = rows.join(winners, "digest")
    own = Window.partitionBy("digest")
    others = (
        rows.join(winners.select("digest"), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(own))
        .withColumn("best", best.over(own))
    )
    columns = [
        F.col("uid"),
        F.col("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("best.uid") == F.col("uid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    ]
    return frequent.select(*columns).unionByName(others.select(*columns))


def digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table (uid, doc_id, length, digest) with a row for each document."""
    return written(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            quoted(id_column).alias("doc_id"),
            F.coalesce(F.length(quoted(text)), F.lit(0)).alias("length"),
            text_digest(quoted(text)).alias("digest"),
        ),
        "dedup-digests",
    )


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, under the columns of ``docs``.

    Winners are found by digest and doc_id, without shuffling texts by group. Only where several rows share both does
    one of them have to be picked, and only those rows move.
    """
    kept = exact_groups(digests(docs, id_column, text)).select("text_sha256", "doc_id", "kept")
    longest = [F.length(quoted(text)).desc_nulls_last(), quoted(text)]
    return surviving(docs, {"text_sha256": text_digest(quoted(text))}, kept, id_column, longest)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(digests(docs)).drop("uid")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       (count(*) OVER (PARTITION BY text_sha256))::BIGINT AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""
