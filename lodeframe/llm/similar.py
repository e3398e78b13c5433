"""SimHash near-dedup by similarity: documents whose sets of word shingles have a Jaccard similarity of about 0.8 or more.

At that similarity fingerprints of 64 bits differ in some ten, too many for blocks that must all but agree. Fingerprints here
have 1,024 bits, of which such documents differ in 155 on average, so that each of 64 blocks of 16 bits agrees with
probability 0.07 and one of them with 0.99. Fingerprints that share a block meet in a file, first in 128 of their bits, to
find those that have a partner at all; only these are filed again whole, compared and linked by a spanning forest of each file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from .common import TEXT_ROWS, partitions, quoted, surviving, written

#: 64-bit words of a fingerprint; blocks have 16 bits.
WORDS = 16
#: Bits that may differ: a similarity of 0.8 makes 155 likely, with a deviation of 12; 0.7 makes 196.
NEAR = 172
#: Of the first SHORT words, bits that may differ for two fingerprints to be looked at whole; unrelated ones differ in 64.
SHORT, SHORT_NEAR = 2, 40
#: Fingerprints of a file that are compared with one another; of a larger file all are looked at whole.
CROWDED = 512
#: Whole fingerprints of a file that are compared at once; a larger file is compared part by part.
HELD = 50_000
#: Shingles whose bits are counted at once.
STEP = 2_048


def wide_fingerprint(text: str | None, shingle: int = 5) -> bytes:
    """The fingerprint of a text's set of shingles, ASCII letters in lower case; zeros for null and texts without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8 * WORDS)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    first = np.append(0, ends[:-1] + 1)[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(first.tolist(), ends[k - 1 :].tolist())], np.uint64))
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), STEP):
        # each shingle's further words: its hash, moved by another multiple and mixed (splitmix64)
        x = hashes[at : at + STEP, None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of words."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(len(column), -1)


def _filed(vertices: DataFrame, words: int) -> DataFrame:
    """(v, fp) under each of its blocks, with so many words of the fingerprint: file, v, fp, sorted by file."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                fps = _matrix(part.column("fp"))
                blocks = fps.view("<u2").astype(np.int32)
                files = (np.arange(blocks.shape[1], dtype=np.int32) << 16 | blocks).ravel()
                ids = np.repeat(part.column("v").to_numpy(), blocks.shape[1])
                short = np.repeat(np.ascontiguousarray(fps[:, :words]), blocks.shape[1], axis=0)
                data = pa.py_buffer(short.tobytes())
                values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(files), [None, data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(ids), values], ["file", "v", "fp"])

    keyed = vertices.select("v", "fp").mapInArrow(files, "file int, v long, fp binary")
    return keyed.repartition(partitions(vertices.sparkSession), "file").sortWithinPartitions("file")


def _by_files(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(file, v, fp) of whole files, many at a time; of a file with more than ``most`` members parts, marked so."""
    file, v, fp = np.empty(0, np.int32), np.empty(0, np.int64), None
    for batch in batches:
        if not len(batch):
            continue
        new = batch.column("file").to_numpy(), batch.column("v").to_numpy(), _matrix(batch.column("fp"))
        file, v = np.append(file, new[0]), np.append(v, new[1])
        fp = new[2] if fp is None or not len(fp) else np.concatenate([fp, new[2]])
        last = int(np.searchsorted(file, file[-1]))
        if last:
            yield file[:last], v[:last], fp[:last], False
            file, v, fp = file[last:], v[last:], fp[last:]
        if len(file) > most:
            yield file, v, fp, True
            file, v, fp = file[:0], v[:0], fp[:0]
    if len(file):
        yield file, v, fp, False


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v of those that come near another one of their file in the first words, or are in a large file."""
    large = None
    for file, v, fp, part in _by_files(batches, CROWDED):
        found = file == large if large is not None else np.zeros(len(file), bool)
        if part:
            large, found = file[0], np.ones(len(file), bool)
        step = 1
        while step < len(file) and (same := file[step:] == file[:-step]).any():
            if step > CROWDED:  # whole files of more than that came in one batch
                found[step:] |= same
                found[:-step] |= same
                sizes = np.searchsorted(file, file, "right") - np.searchsorted(file, file)
                found |= sizes > CROWDED
                break
            at = np.flatnonzero(same)
            at = at[differing(fp[at], fp[at + step]) <= SHORT_NEAR]
            found[at] = found[at + step] = True
            step += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(v[found]))], ["v"])


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect what links of at most NEAR bits connect."""
    links, left, todo = [], np.arange(len(fps)), []
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        near = differing(fps[left], fps[at]) <= NEAR
        links += [(at, int(j)) for j in left[near]]
        todo += left[near].tolist()
        left = left[~near]
    return links


def _cross(seen: np.ndarray, groups: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) of at most NEAR bits from each of ``fps`` to one of ``seen`` in each of their ``groups``."""
    links = []
    for i, fp in enumerate(fps):
        near = np.flatnonzero(differing(seen, fp) <= NEAR)
        links += [(i, int(near[k])) for k in np.unique(groups[near], return_index=True)[1]]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): forests of the files. A file with more than HELD members is compared part by part, each with all earlier ones."""
    carried: tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] | None = None
    for file, v, fp, part in _by_files(batches, HELD):
        out: list[tuple[int, int]] = []
        starts = np.flatnonzero(np.append(True, file[1:] != file[:-1]))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(file)).tolist()):
            ids, own = v[a:b], fp[a:b]
            found = forest(own) if len(ids) > 1 else []
            out += [(int(ids[i]), int(ids[j])) for i, j in found]
            earlier = carried[1] if carried and carried[0] == file[a] else []
            for before, seen, groups in earlier:
                out += [(int(ids[i]), int(before[j])) for i, j in _cross(seen, groups, own)]
            if part:
                groups = np.arange(len(ids))
                for i, j in found:  # i comes before its j in the forest
                    groups[j] = groups[i]
                carried = file[a], [*earlier, (ids, own, groups)]
        u, w = (pa.array([x[k] for x in out], pa.int64()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([u, w], ["u", "v"])


def near_links(vertices: DataFrame) -> DataFrame:
    """Links (u, v) among ``vertices`` (v, fp: all different; a stored table), enough to connect all that share a block and are
    near."""
    some = written(_filed(vertices, SHORT).mapInArrow(_with_partners, "v long"), "similar-some").distinct()
    whole = written(vertices.join(some, "v", "left_semi"), "similar-whole")
    return written(_filed(whole, WORDS).mapInArrow(_links, "u long, v long"), "similar-links").distinct()


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """A stored table with a row for each document: doc_id, text_hash, and of its group's document that stays best_id and
    best_hash: the one with the smallest id (null last), then hash.

    Null and empty texts have no shingles and one fingerprint, so that they are a group; texts of fewer words than a shingle are
    one shingle. Equal fingerprints are one vertex, however many rows have them. Texts of any length count whole, and an empty
    table gives an empty one.
    """
    wide = F.pandas_udf(lambda texts: texts.map(lambda t: wide_fingerprint(t, shingle)), "binary")
    text_column = F.coalesce(quoted(text), F.lit(""))
    of = docs.select(quoted(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), wide(text_column).alias("fp"))
    rows = written(of, "similar", TEXT_ROWS)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    vertices = written(rows.groupBy("fp").agg(best).withColumn("v", F.monotonically_increasing_id()), "similar-vertices")
    roots = components(near_links(vertices.select("v", "fp"))).toDF("v", "root")
    rooted = vertices.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    rooted = written(rooted, "similar-roots")
    groups = rooted.groupBy("root").agg(F.min("best").alias("first"))
    named = written(rooted.select("fp", "root").join(groups, "root").select("fp", "first"), "similar-named")
    told = rows.join(named, "fp").select("doc_id", "text_hash", F.col("first.doc_id").alias("best_id"), F.col("first.text_hash").alias("best_hash"))
    return written(told, "similar-groups")


def without_similar(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """The documents that stay, one of each group of similar_groups(), under the columns of ``docs``. Of rows with one id and
    text one stays."""
    kept = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash"))
    verdicts = similar_groups(docs, id_column, text, shingle).select("text_hash", "doc_id", kept.alias("kept"))
    text_hash = F.xxhash64(F.coalesce(quoted(text), F.lit("")))
    return surviving(docs, {"text_hash": text_hash}, verdicts, id_column, [quoted(text)])
