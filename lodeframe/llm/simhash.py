"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked where at most three bits differ.

Fingerprints are cut into six blocks. Two that differ in at most three bits share three blocks at least, so each
fingerprint is filed under all 20 choices of three blocks (about 32 bits), and only fingerprints filed together are
compared. Equal fingerprints are one vertex from the start. A file with more than ``CROWDED`` different fingerprints is
filed anew by the rest of their bits, cut into eight blocks of which links share five; three blocks are then left, so
that no such file can hold more than 2**15 different fingerprints. From each file come the links of a spanning forest,
never all pairs, and from these the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.components import components
from .common import TEXT_ROWS, partitions, quoted, surviving, written

#: Bits that may differ.
DISTANCE = 3
#: Different fingerprints that are compared with one another directly.
CROWDED = 512


def _blocks(bits: list[int], n: int) -> list[int]:
    """The bits in n blocks, as masks."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: Masks of the files: any three of six blocks; for each, any five of eight blocks of the other bits as well.
FILES = [a | b | c for a, b, c in combinations(_blocks(list(range(64)), 6), 3)]
REFILES = [
    [mask | sum(five) for five in combinations(_blocks([b for b in range(64) if not mask >> b & 1], 8), 5)]
    for mask in FILES
]


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text as an unsigned number; 0 for null and for texts without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() takes A-Z and split() ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], 42) for a, b in zip(first[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())],
        dtype="<u8",
    )
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so that a very long text needs little memory
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """A stored table (doc_id, text_hash, fp): for each row its id, a hash of its text and its fingerprint as a long."""

    @pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    text_column = F.coalesce(quoted(text), F.lit(""))
    return written(
        docs.select(quoted(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), fingerprint(text_column).alias("fp")),
        "simhash",
        TEXT_ROWS,
    )


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect what links of at most DISTANCE bits among the values connect."""
    if len(values) == 2:
        return [(0, 1)] if int(values[0] ^ values[1]).bit_count() <= DISTANCE else []
    links, left, todo = [], np.arange(len(values)), []
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        near = np.bitwise_count(values[left] ^ values[at]) <= DISTANCE
        links += [(at, int(j)) for j in left[near]]
        todo += left[near].tolist()
        left = left[~near]
    return links


def _link_frame(rows: list[tuple]) -> pd.DataFrame:
    """(file, u, v) with nulls; whole numbers stay whole on the way, which a column of floats would round."""
    columns = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({n: pd.array(list(c), dtype=t) for n, c, t in zip(("file", "u", "v"), columns, ("Int32", "Int64", "Int64"))})


def _file_links(crowded: int | None):
    """For mapInPandas over (file, key, fp), sorted by file and key: links (file null, u, v), and for files of more
    than ``crowded`` members the members themselves (file, u), in bounded memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current, over = [], None, False

        def finish() -> list[tuple]:
            if over or len(held) < 2:
                return []
            values = np.array(held, dtype=np.int64).view(np.uint64)
            return [(None, held[i], held[j]) for i, j in _forest(values)]

        for batch in batches:
            out: list[tuple] = []
            for file, key, fp in zip(batch["file"].tolist(), batch["key"].tolist(), batch["fp"].tolist()):
                if current != (file, key):
                    out += finish()
                    held, current, over = [], (file, key), False
                if over:
                    out.append((file, fp, None))
                    continue
                held.append(fp)
                if crowded and len(held) > crowded:
                    out += [(file, x, None) for x in held]
                    held, over = [], True
            yield _link_frame(out)
        yield _link_frame(finish())

    return run


def _filed(fps: DataFrame, masks: Column, file: Column, crowded: int | None) -> DataFrame:
    """fps (file?, fp): each under all masks (an array of longs), compared file by file."""
    n = partitions(fps.sparkSession)
    keyed = fps.select(F.posexplode(masks).alias("at", "mask"), "fp", file.alias("file0"))
    keyed = keyed.select(
        (F.col("file0") * 64 + F.col("at")).cast("int").alias("file"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    dealt = keyed.repartition(n, "file", "key").sortWithinPartitions("file", "key")
    return dealt.mapInPandas(_file_links(crowded), "file int, u long, v long")


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) among different fingerprints ``fps`` (fp), enough to connect all that are near."""
    masks = F.array(*[F.lit(_signed(m)) for m in FILES])
    first = written(_filed(fps, masks, F.lit(0), CROWDED), "simhash-files")
    crowded = first.where(F.col("file").isNotNull()).select("file", F.col("u").alias("fp"))
    again = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in REFILES])
    second = _filed(crowded, F.get(again, F.col("file")), F.col("file") + 1, None)
    links = first.where(F.col("file").isNull()).select("u", "v")
    return links.unionByName(second.where(F.col("file").isNull()).select("u", "v"))


def near_groups(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp, ...; a stored table) with component_id, the smallest doc_id that links reach; null ids count
    last, and a component of null ids alone has a null one. Texts of any length are one fingerprint here; null and empty
    texts have 0, which links like any other. Repeated rows and ids stay, each with its component; equal fingerprints are
    one vertex, however many rows have them. An empty table gives an empty one. ``rows`` must have no columns
    least, root or component_id of its own, as those of fingerprints() have not; documents' own columns never get there."""
    vertices = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-vertices")
    roots = components(near_links(vertices.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = vertices.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp")


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each group: that with the smallest id (null last)."""
    groups = near_groups(fingerprints(docs, id_column, text))
    leader = F.col("doc_id").eqNullSafe(F.col("component_id"))
    # rows of one id and different texts can both lead; the one with the smaller hash stays
    best = F.min(F.when(leader, F.struct("component_id", "text_hash")))
    named = written(groups.select("doc_id", "text_hash", "component_id", "fp"), "simhash-groups")
    leaders = named.groupBy("component_id").agg(best.alias("best")).select(
        F.col("component_id").alias("of"), F.col("best.text_hash").alias("best_hash")
    )
    verdicts = named.join(leaders, named["component_id"].eqNullSafe(leaders["of"])).select(
        "text_hash", "doc_id", (leader & (F.col("text_hash") == F.col("best_hash"))).alias("kept")
    )
    text_hash = F.xxhash64(F.coalesce(quoted(text), F.lit("")))
    return surviving(docs, {"text_hash": text_hash}, verdicts, id_column, [quoted(text)])


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(fingerprints(docs)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
