"""Mixing sources to target weights.

Each row gets a hash-random key. Within its source the rows are dealt into ranges of that key, so that a source of any
size spreads over as many tasks as its share of the rows asks for. Sums by range, added up in order, and a running sum
within each range give every row the words that lie before it; the cut at the source's budget follows row by row.
No row of text is shuffled unless the caller carries the text along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, fresh, if_small, partitions, quoted, word_count, written

#: Ranges of the key for each shuffle partition.
RANGES = 4
#: A block of ranges holds so many bits of their numbers.
BLOCK_BITS = 5


def hash_key(doc_id: Column, seed: str = "mix", tie: Column | None = None) -> Column:
    """60 random bits that depend on the id alone, for null ids on ``tie``; without one these share a key."""
    unnamed = F.lit("") if tie is None else F.concat(F.lit("\t"), F.coalesce(tie.cast("string"), F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), unnamed)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0
) -> DataFrame:
    """``sizes`` (source, source_size, source_rows) with sid, weight and target.

    Sources in code-point order, null last, get the weights in turn. All targets together make ``share`` of all sizes;
    none is above ``limit`` times its source's size, and what that cuts goes to the others by weight. Where even all
    limits are below the share, each target is its limit. This table has a row for each source, so that it is ranked
    in one task.
    """
    everywhere = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "sid", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())).cast("int")
    )
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("sid") - 1) % len(weights))).withColumn(
        "most", F.col("source_size") * F.lit(float(limit))
    )
    by_level = everywhere.orderBy(F.col("most") / F.col("weight"), "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    filled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_level))
    first_free = F.min(F.when(F.col("level") < F.col("most") / F.col("weight"), F.struct("place", "level")))
    return filled.withColumn("final", first_free.over(everywhere).getField("level")).select(
        "source",
        "source_size",
        "source_rows",
        "sid",
        "weight",
        F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("final"), F.col("most"))).alias("target"),
    )


def mix(
    rows: DataFrame,
    size: str = "size",
    id_column: str = "doc_id",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    seed: str = "mix",
    tie: str | None = None,
) -> DataFrame:
    """``rows`` with source_size, target and taken; columns of ``rows`` with these names are replaced.

    ``size`` is a column of longs; null counts as 0. taken is what the mix takes of the row, in the unit of size:
    whole epochs first, then the rows in order of their keys up to the source's budget (its target, rounded down), so
    that the row at the cut is taken in part and the sums meet every budget exactly. Rows with equal ids are ordered by
    size, then by the column ``tie`` if one is named, and rows equal in all can stand for each other. Rows with null ids get
    their keys from ``tie`` and spread like others; without it they are one group. A null source is a source. A row of any size, a very long text's, is taken in part where it lies at the cut. Empty tables give empty results.
    ``rows`` is read three times: give a stored table.
    """
    spark = rows.sparkSession
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("source_size", "target", "taken")])
    names = ("source", "size", "key", "range", "before", "sid", "ranges", "offset", "total", "target")
    n = {x: fresh(rows, f"__mix_{x}") for x in names}
    keyed = rows.select(
        *[quoted(c) for c in rows.columns],
        quoted(source).alias(n["source"]),
        F.coalesce(quoted(size), F.lit(0)).cast("long").alias(n["size"]),
        hash_key(quoted(id_column), seed, quoted(tie) if tie else None).alias(n["key"]),
    )
    sizes = keyed.groupBy(F.col(n["source"]).alias("source")).agg(
        F.sum(n["size"]).alias("source_size"), F.count(F.lit(1)).alias("source_rows")
    )
    share_of_rows = F.col("source_rows") / F.sum("source_rows").over(Window.partitionBy(F.lit(0)))
    targets = source_targets(sizes, weights, share, limit).select(
        F.col("source").alias("__mix_of"),
        F.col("sid").alias(n["sid"]),
        F.col("source_size").alias(n["total"]),
        F.col("target").alias(n["target"]),
        F.greatest(F.lit(1), F.ceil(share_of_rows * partitions(spark) * RANGES)).cast("long").alias(n["ranges"]),
    )
    # stored, so that its size is known: Spark broadcasts it below its threshold, and joins by shuffle above
    targets = written(targets, "mix-targets")
    ranged = (
        keyed.join(targets, F.col(n["source"]).eqNullSafe(F.col("__mix_of")))
        .drop("__mix_of")
        .withColumn(n["range"], F.shiftright(F.shiftright(F.col(n["key"]), 30) * F.col(n["ranges"]), 30))
    )
    own = [n["sid"], n["range"]]
    sums = ranged.groupBy(*own).agg(F.sum(n["size"]).alias("range_size"))
    # ranges are added up by blocks of them, so that no task sees all ranges of a large source
    sums = sums.withColumn("block", F.shiftright(n["range"], BLOCK_BITS))
    earlier = lambda last, *by: Window.partitionBy(*by).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    blocks = sums.groupBy(n["sid"], "block").agg(F.sum("range_size").alias("block_size"))
    blocks = blocks.select(n["sid"], "block", before("block_size", earlier("block", n["sid"])).alias("blocks_before"))
    sums = sums.withColumn("ranges_before", before("range_size", earlier(n["range"], n["sid"], "block")))
    offsets = sums.join(blocks, [n["sid"], "block"]).select(
        *own, (F.col("blocks_before") + F.col("ranges_before")).alias(n["offset"])
    )
    within = (
        Window.partitionBy(*own)
        .orderBy(n["key"], quoted(id_column), n["size"], *([quoted(tie)] if tie else []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = ranged.withColumn(n["before"], F.coalesce(F.sum(n["size"]).over(within), F.lit(0)))
    total, words = F.col(n["total"]), F.col(n["size"])
    budget = F.floor(n["target"]).cast("long")
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(0).cast("long")
    rest = budget - epochs * total - F.col(n["offset"]) - F.col(n["before"])
    taken = epochs * words + F.least(F.greatest(rest, F.lit(0).cast("long")), words)
    return placed.join(offsets, own).select(
        *[quoted(c) for c in rows.columns],
        total.cast("long").alias("source_size"),
        F.col(n["target"]).alias("target"),
        taken.cast("long").alias("taken"),
    )


def source_cuts(plan: DataFrame, order: Sequence[str]) -> DataFrame:
    """What the mix takes of each source, from a stored result of mix() with columns source and size, and the columns
    ``order`` by which it went: source, epochs, cut (the columns ``order`` of the first row with words that isn't taken
    once more; null if there is none), at_cut (how many rows are equal to it), extra (the words that these are taken
    for beyond the epochs). A stored row for each source."""
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rows = plan.where("size > 0").select("source", "size", F.struct(*order).alias("at"), epochs.alias("epochs"), (F.col("taken") - epochs * F.col("size")).alias("more"))
    cuts = rows.groupBy("source", "epochs").agg(F.min(F.when(F.col("more") < F.col("size"), F.col("at"))).alias("cut"))
    cuts = if_small(written(cuts, "mix-cuts"))
    of = cuts.select(F.col("source").alias("of"), "cut")
    equal = rows.join(of, F.col("source").eqNullSafe(F.col("of")) & F.col("at").eqNullSafe(F.col("cut")))
    sums = equal.groupBy(F.col("of")).agg(F.count(F.lit(1)).alias("at_cut"), F.sum("more").alias("extra"))
    found = cuts.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return written(found, "mix-cuts-met")


def mixed_documents(
    docs: DataFrame, text: str = "text", n_chars: str = "n_chars", id_column: str = "doc_id", source: str = "source", **options
) -> DataFrame:
    """The mix itself: each document as often as it is taken, under the columns of ``docs``.

    A document that the budget cuts comes once more with its first words only, white space as it was, and with its
    n_chars (if there is such a column) brought up to date. Documents without words are in no mix. Only ids and sizes are
    mixed; as a source's rows are taken whole up to one of them, a row for each source tells every document how often it
    comes, where its text is. Rows that are equal in id and text take turns at a cut, and only those are brought together.
    """
    seed = options.pop("seed", "mix")
    tie = F.xxhash64(F.coalesce(quoted(text), F.lit("")))
    key = hash_key(quoted(id_column), seed, tie)
    size = word_count(quoted(text))
    slim = docs.select(quoted(id_column).alias("id"), quoted(source).alias("source"), size.alias("size"), tie.alias("tie"), key.alias("key"))
    order = ("key", "id", "size", "tie")
    plan = mix(written(slim, "mix-sizes"), id_column="id", seed=seed, tie="tie", **options)
    cuts = source_cuts(written(plan, "mix-plan"), order)
    single = (cuts.agg(F.max("at_cut")).first()[0] or 0) <= 1

    names = ("of", "epochs", "cut", "at_cut", "extra", "key", "side", "words", "rank", "copy", "text")
    n = {x: fresh(docs, f"__mixed_{x}") for x in names}
    cuts = if_small(cuts.withColumnsRenamed({"source": n["of"], **{x: n[x] for x in ("epochs", "cut", "at_cut", "extra")}}))
    found = docs.withColumn(n["key"], key).where(quoted(text).rlike(WORD))
    found = found.join(cuts, quoted(source).eqNullSafe(F.col(n["of"])))
    own, cut = F.struct(F.col(n["key"]).alias("key"), quoted(id_column).alias("id")), F.struct(F.col(n["cut"])["key"].alias("key"), F.col(n["cut"])["id"].alias("id"))
    whole = F.struct(size.alias("size"), tie.alias("tie"))
    rest = F.struct(F.col(n["cut"])["size"].alias("size"), F.col(n["cut"])["tie"].alias("tie"))
    compared = lambda a, b, equal: F.when(a < b, -1).when(a > b, 1).otherwise(equal)
    # words are counted only where a row has the id of the cut
    found = found.withColumn(n["side"], F.when(F.col(n["cut"]).isNull(), -1).otherwise(compared(own, cut, compared(whole, rest, F.lit(0)))))
    words = F.when(F.col(n["side"]) == 0, F.col(n["cut"])["size"])
    if single:
        ranked = found.withColumn(n["rank"], F.lit(1))
    else:
        by = Window.partitionBy(n["of"]).orderBy(F.lit(0))
        ranked = found.where(F.col(n["side"]) != 0).withColumn(n["rank"], F.lit(1))
        ranked = ranked.unionByName(found.where(F.col(n["side"]) == 0).withColumn(n["rank"], F.row_number().over(by)))
    left = F.col(n["extra"]) - (F.col(n["rank"]) - 1) * words
    own_extra = F.greatest(F.least(left, words), F.lit(0).cast("long"))
    # of the last copy, so many words; null where it is whole
    part = F.when((F.col(n["side"]) == 0) & (own_extra > 0) & (own_extra < words), own_extra).cast("int")
    more = F.when(F.col(n["side"]) < 0, 1).when((F.col(n["side"]) == 0) & (own_extra > 0), 1).otherwise(0)
    ranked = ranked.withColumn(n["words"], part).withColumn(n["at_cut"], (F.col(n["epochs"]) + more).cast("int"))
    copies = ranked.where(F.col(n["at_cut"]) > 0).withColumn(n["copy"], F.explode(F.sequence(F.lit(1), F.col(n["at_cut"]))))
    short = (F.col(n["copy"]) == F.col(n["at_cut"])) & F.col(n["words"]).isNotNull()
    pieces = F.regexp_extract_all(quoted(text), F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    shortened = F.when(short, F.array_join(F.slice(pieces, 1, F.col(n["words"])), "")).otherwise(quoted(text))
    out = copies.withColumn(n["text"], shortened)
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(n["text"]).alias(c))
        elif c == n_chars:
            columns.append(F.when(short, F.length(n["text"])).otherwise(quoted(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(quoted(c))
    return out.select(*columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tie = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("tie")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tie), "mix-sizes")
    return mix(sized, tie="tie").select("doc_id", "size", "source_size", "target", "taken", "source")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, chr(9) || md5(coalesce(text, '')))), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS most
  FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
           - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM w WINDOW o AS (ORDER BY most / weight, sid)
), t AS (
  SELECT *, least(most, coalesce(weight * (SELECT arg_min(lvl, place) FROM l WHERE lvl < most / weight), most)) AS target
  FROM l
), p AS (
  SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY t.sid ORDER BY k, doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(greatest(CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - before, 0), size))::BIGINT AS taken,
       source
FROM p
"""
