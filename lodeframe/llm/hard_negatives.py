"""Hard negatives: rows of another label that are nearly as near to an anchor as its positives.

Anchors go out in blocks of bounded size; every task multiplies a block with the candidates it reads, batch by batch, as
dense matrices of doubles, in which integers below 2 ** 53 are exact. The first pass keeps each anchor's best rows of its own
label, the second the best rows of other labels in the window that each of those positives opens. What a task keeps is
a few rows for each anchor; tasks' results are merged by a window over the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

#: Bytes of vectors in a block of anchors, which is what is broadcast at once.
BLOCK_BYTES = 16 << 20
#: Candidates that a task takes at once, at most.
ROWS = 10_000
#: Products of an anchor and a candidate that are held at once in a task.
PRODUCTS = 1 << 20
#: Doubles hold all integers below this.
EXACT = 2.0**53
#: The ends of a long, where scores beyond it are put.
LEAST, MOST = -(2**63), 2**63 - 1


def usable(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that take part, as vec_id, label, vector (array of doubles): no null id, label or vector, no null or
    non-finite component, and of rows that share an id the first by label, then vector."""
    parts = quoted(vector).cast("array<double>")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = quoted(id_column).isNotNull() & quoted(label).isNotNull() & quoted(vector).isNotNull() & finite
    one = F.min(F.struct(F.col("label"), F.col("vector")))
    chosen = rows.where(whole).select(quoted(id_column).cast("long").alias("vec_id"), quoted(label).alias("label"), parts.alias("vector"))
    return chosen.groupBy("vec_id").agg(one.alias("one")).select("vec_id", "one.label", "one.vector")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones with zeros behind."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as longs. Where doubles might not hold one, by Python's integers instead; one that
    a long doesn't hold is put at the long's end."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


class Best:
    """The first k by score (higher first), then id (smaller first), of each of n lists."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.owner, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.full = np.zeros(n, bool)
        self.worst, self.worst_id = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def may_enter(self, owners: slice | np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """scores: a row for each owner, a column for each id."""
        worst = self.worst[owners, None]
        return ~self.full[owners, None] | (scores > worst) | ((scores == worst) & (ids < self.worst_id[owners, None]))

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, ids)))
        by = np.lexsort((ids, ~score, owner))  # ~x falls as x rises, and has no overflow
        owner, score, ids = owner[by], score[by], ids[by]
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        place = np.arange(len(owner)) - np.repeat(begins, np.diff(np.append(begins, len(owner))))
        kept = place < self.k
        self.owner, self.score, self.id = owner[kept], score[kept], ids[kept]
        last = place == self.k - 1
        self.full[owner[last]] = True
        self.worst[owner[last]], self.worst_id[owner[last]] = score[last], ids[last]


class Block:
    """A block of anchors: ids, labels by number and vectors; later their positives (anchor_id, positive_id, score)."""

    def __init__(self, table: pa.Table):
        sizes = table.column("vector").combine_chunks().offsets.to_numpy()
        self.ids = table.column("vec_id").to_numpy()
        self.number: dict = {}
        self.labels = np.array([self.number.setdefault(x, len(self.number)) for x in table.column("label").to_pylist()], np.int64)
        self.vectors = _matrix(table.column("vector"), int(np.diff(sizes).max(initial=0)))
        self.positives: pa.Table | None = None

    def windows(self) -> None:
        """What scores each positive asks for: half of its own to 95 % of it, in whole numbers."""
        score = [int(x) for x in self.positives.column("score").to_pylist()]
        self.low = np.array([-(-s // 2) for s in score], np.int64)
        self.high = np.array([95 * s // 100 for s in score], np.int64)
        row = {int(x): i for i, x in enumerate(self.ids)}
        self.row = np.array([row[x] for x in self.positives.column("anchor_id").to_pylist()], np.int64)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For parts of the block: the anchors' rows, their products with the candidates, whether labels agree, and the
        candidates' ids."""
        ids, there, anchors = batch.column("vec_id").to_numpy(), batch.column("vector"), self.vectors
        if not len(ids):
            return
        width = max(anchors.shape[1], int(np.diff(there.offsets.to_numpy()).max(initial=0)))
        candidates = _matrix(there, width)[:, : anchors.shape[1]]  # beyond it all anchors are zero
        others = np.array([self.number.get(x, -1) for x in batch.column("label").to_pylist()], np.int64)
        step = max(1, PRODUCTS // len(ids))
        for first in range(0, len(anchors), step):
            rows = np.arange(first, min(first + step, len(anchors)))
            yield rows, products(anchors[rows], candidates), self.labels[rows, None] == others[None], ids


def nearest(block: Block, batches: Iterator[pa.RecordBatch], k: int) -> Best:
    """Of the candidates, the first k others of each anchor's label."""
    best = Best(len(block.ids), k)
    for batch in batches:
        for rows, scores, same, ids in block.scores(batch):
            wanted = same & (block.ids[rows, None] != ids[None]) & best.may_enter(rows, scores, ids)
            at, to = np.nonzero(wanted)
            best.add(rows[at], scores[at, to], ids[to])
    return best


def windowed(block: Block, batches: Iterator[pa.RecordBatch], k: int) -> Best:
    """Of the candidates, the first k of another label in the window of each positive."""
    best = Best(len(block.row), k)
    for batch in batches:
        for rows, scores, same, ids in block.scores(batch):
            mine = np.flatnonzero((block.row >= rows[0]) & (block.row <= rows[-1]))
            step = max(1, PRODUCTS // len(ids))
            for first in range(0, len(mine), step):
                pairs = mine[first : first + step]
                at = block.row[pairs] - rows[0]
                found = scores[at]
                wanted = ~same[at] & (found >= block.low[pairs, None]) & (found <= block.high[pairs, None])
                i, to = np.nonzero(wanted & best.may_enter(pairs, found, ids))
                best.add(pairs[i], found[i, to], ids[to])
    return best


def _merged(partial: DataFrame, owner: list[str], k: int) -> DataFrame:
    order: list[Column] = [F.col("score").desc(), F.col("id")]
    place = F.row_number().over(Window.partitionBy(*owner).orderBy(*order))
    return partial.withColumn("rank", place).where(F.col("rank") <= k)


def _mined(anchors: DataFrame, candidates: DataFrame, positives: int, negatives: int, batch: int) -> DataFrame:
    """Both passes for one block of anchors; both tables are stored. A task takes ``batch`` candidates at once."""
    spark = anchors.sparkSession
    block = Block(anchors.select("vec_id", "label", "vector").orderBy("vec_id").toArrow())
    sent = spark.sparkContext.broadcast(block)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        best = nearest(held, batches, positives)
        yield pa.RecordBatch.from_arrays([pa.array(held.ids[best.owner]), pa.array(best.id), pa.array(best.score)], ["anchor_id", "id", "score"])

    partial = candidates.mapInArrow(near, "anchor_id long, id long, score long")
    best = written(_merged(partial, ["anchor_id"], positives), "positives", batch)
    best = best.select("anchor_id", F.col("id").alias("positive_id"), "score")
    block.positives = best.orderBy("anchor_id", F.col("score").desc(), "positive_id").toArrow()  # a few for each anchor
    block.windows()
    sent.destroy()
    sent = spark.sparkContext.broadcast(block)

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        best = windowed(held, batches, negatives)
        of = held.positives.take(pa.array(best.owner)).combine_chunks()
        columns = [of.column("anchor_id"), of.column("positive_id"), of.column("score")]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        names = ["anchor_id", "positive_id", "positive_score", "id", "score"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(best.id), pa.array(best.score)], names)

    schema = "anchor_id long, positive_id long, positive_score long, id long, score long"
    found = _merged(candidates.mapInArrow(hard, schema), ["anchor_id", "positive_id"], negatives)
    found = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    out = written(found.select(columns), "hard-negatives", batch)
    sent.destroy()
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id long, label, vector: array of whole numbers as doubles; as
    usable() gives them, each vec_id once).

    An anchor's positives are its first ``positives`` other rows of its label by inner product (higher first), then
    vec_id. For each of them the first ``negatives`` rows of other labels whose product with the anchor is at least half
    and at most 95 % of the positive's are returned: anchor_id, positive_id, rank (int, from 1), negative_id,
    positive_score, negative_score. Anchors without positives and positives without negatives have no rows; a product of
    0 opens a window of zeros, a negative one none. Of vectors of different lengths the shorter count as having zeros
    behind. An empty table gives an empty one.

    Equal vectors and ties in any number are settled by vec_id and leave a task with a few rows for each anchor. Each
    block of anchors, BLOCK_BYTES at most but for uneven hashes, is one broadcast and reads the candidates twice.
    """
    stored = written(rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), "embeddings")
    weight = 8 * F.size("vector") + 24
    figures = stored.agg(F.sum(F.when(F.col("is_anchor"), weight)).alias("anchors"), F.max(weight).alias("widest")).first()
    blocks = -(-(figures["anchors"] or 0) // BLOCK_BYTES)
    batch = max(1, min(ROWS, BLOCK_BYTES // (figures["widest"] or 1)))
    candidates = stored.select("vec_id", "label", "vector")
    if blocks > 1:
        anchors = written(stored.where("is_anchor").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "anchors")
        parts = [anchors.where(F.col("block") == i) for i in range(blocks)]
    else:
        parts = [stored.where("is_anchor")]
    return reduce(DataFrame.unionByName, [_mined(p, candidates, positives, negatives, batch) for p in parts])


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(256 * x).cast("double")).otherwise(256 * x))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), whole.alias("vector")), F.col("vec_id") % 50 == 0)


OP13_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       (row_number() OVER w)::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3
"""
