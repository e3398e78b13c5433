"""Runs: stretches of words that repeat themselves with some period.

A task takes documents some 60,000 words at a time as one string of word numbers. Its suffix array (by doubling), the
lengths that neighbours in it share and a table of range minima tell how far any two places agree to the right; the same
of the reversed string, to the left. For each period p the places 0, p, 2p, ... of a document are asked how far they agree
with those p further on: every run of at least 2p words holds such a pair, so that about n ln n questions find all runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, WORD, let, quoted, written

#: Words that are gone through as one string; a longer document makes a string of its own.
WORDS = 60_000
#: Pairs of places that are asked at once.
PAIRS = 1 << 20


class Agreement:
    """How many numbers two places of a string have in common from there on. The last number may occur only once."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        begins = np.append(True, numbers[order[1:]] != numbers[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        ranks, width = [rank.astype(np.int32)], 1  # ranks[i]: by the first 2 ** i numbers
        while True:
            tied = np.flatnonzero(~begins | np.append(~begins[1:], False))
            if not len(tied):
                break
            places = order[tied]
            key = rank[places] * n + rank[places + width]  # what ties at this width doesn't reach the end
            by = np.argsort(key, kind="stable")
            places, key = places[by], key[by]
            order[tied] = places
            first = np.append(True, key[1:] != key[:-1])
            begins[tied] = first
            rank[places] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
            ranks.append(rank.astype(np.int32))
            width *= 2
        self.place = rank.astype(np.int32)  # in the suffix array
        shared = np.zeros(n, np.int32)  # with the suffix before
        left, right = order[:-1], order[1:]
        for i in reversed(range(len(ranks))):
            same = ranks[i][left + shared[1:]] == ranks[i][right + shared[1:]]
            shared[1:] += same.astype(np.int32) << i
        del ranks
        self.least = [shared]  # least[i][x]: the minimum of 2 ** i from x on
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))
        self.starts = np.cumsum([0, *map(len, self.least)])[:-1]
        self.least = np.concatenate(self.least)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.place[a], self.place[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp(high - low)[1] - 1
        at = self.starts[level]
        return np.minimum(self.least[at + low], self.least[at + high - (1 << level)])


def runs_of(documents: list[np.ndarray], least: int) -> list[np.ndarray]:
    """For each document, given by its words' numbers, its runs: rows (start, length, period) by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    found = [np.empty((0, 3), np.int64)] * len(documents)
    parts, base = [[0]], 1  # a number of its own stands before, between and after the documents
    for d in documents:
        parts += [d + base, [base + len(d)]]
        base += len(d) + 1
    text = np.concatenate(parts).astype(np.int64)
    asked = np.flatnonzero(sizes >= max(least, 2))
    if not len(asked):
        return found
    begins = np.cumsum(sizes + 1) - sizes  # of each document in the text
    ahead, back, last = Agreement(text), Agreement(text[::-1].copy()), len(text) - 1

    halves = sizes[asked] // 2
    document = np.repeat(asked, halves)
    period = np.arange(len(document)) - np.repeat(np.cumsum(halves) - halves, halves) + 1
    points = (sizes[document] - 1) // period
    upto = np.cumsum(points)
    hits, first = [], 0
    while first < len(period):
        stop = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        own = slice(first, stop)
        n = points[own]
        step = np.repeat(period[own], n)
        nth = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
        a = np.repeat(begins[document[own]], n) + nth * step
        same = text[a] == text[a + step]
        a, p, d = a[same], step[same], np.repeat(document[own], n)[same]
        right = ahead(a, a + p)
        left = back(last + 1 - a, last + 1 - a - p)
        length = left + right + p
        run = length >= np.maximum(2 * p, least)
        hits.append(np.stack([d, a - left - begins[d], length, p])[:, run])
        first = stop
    d, start, length, p = np.concatenate(hits, axis=1)
    by = np.lexsort((p, length, start, d))  # a run is found at its multiples too; its smallest period comes first
    d, start, length, p = d[by], start[by], length[by], p[by]
    new = np.append(True, (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(d)]
    d, start, length, p = d[new], start[new], length[new], p[new]
    by = np.lexsort((p, start, d))
    d, rows = d[by], np.stack([start, length, p], axis=1)[by]
    cuts = np.searchsorted(d, np.arange(len(documents) + 1))
    return [rows[cuts[i] : cuts[i + 1]] for i in range(len(documents))]


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _outside(runs: np.ndarray, n: int) -> np.ndarray:
    """Of n words, those that no run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _results(texts: list[str | None], least: int) -> tuple[list, list, list]:
    counts, runs, collapsed, pending = [], [], [], []

    def settle() -> None:
        for words, found in zip(pending, runs_of([_numbers(w) for w in pending], least), strict=True):
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
            if len(found):
                words = [w for w, kept in zip(words, _outside(found, len(words)).tolist(), strict=True) if kept]
            collapsed.append(b" ".join(words).decode())
        pending.clear()

    held = 0
    for text in texts:
        words = (text or "").encode().split()  # of bytes: at ASCII white space only
        if pending and held + len(words) > WORDS:
            settle()
            held = 0
        pending.append(words)
        held += len(words)
    settle()
    return counts, runs, collapsed


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """Per row of ``docs``: its id, n_words, runs and the text without them (collapsed).

    A run is a stretch of words (code points other than ASCII white space) with smallest period q, of at least ``least``
    and 2q words, that no neighbouring word extends. Runs come by start, then period, with start, length and period in
    words from 0. ``collapsed`` has the words that no run holds after its first q ones, joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are taken one by one, so that repeated
    rows, null ids and ties have results of their own; other columns are not read, whatever their names; an empty table
    gives an empty one. A text of any length is taken whole, in some 200 bytes of memory for each of its words.
    """
    bare = docs.select(quoted(id_column).alias("doc_id"), quoted(text).cast("string").alias("text"))
    schema = T.StructType(
        [bare.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())]
    )
    kinds = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, collapsed = _results(batch.column("text").to_pylist(), least)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, kinds), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return bare.mapInArrow(found, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document, by h = crc32 of its id, goes on from word a with what it has said from
    there on, p words again and again; a, p as the contract of op12 gives them. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))

    def again(s):
        n = F.size(s["words"])
        bound = F.struct(s["words"].alias("words"), (s["g"] % n).alias("a"), n.cast("long").alias("n"), s["g"].alias("g"))

        def said(x):
            p = (1 + F.floor((x["n"] - x["a"]) / (3 + x["g"] % 8))).alias("p")
            return let(
                F.struct(x["words"].alias("words"), x["a"].alias("a"), p),
                lambda y: F.transform(
                    y["words"],
                    lambda w, i: F.when(i < y["a"], w).otherwise(F.get(y["words"], (y["a"] + (i - y["a"]) % y["p"]).cast("int"))),
                ),
            )

        return F.when(n > 0, F.array_join(let(bound, said), " "))

    planted = let(F.struct(words.alias("words"), g.alias("g")), again)
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    runs = periodic_runs(with_planted_runs(docs))
    first = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = runs.withColumn("longest", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.length").alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return written(out, "periodic-runs", TEXT_ROWS)
