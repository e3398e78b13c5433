"""Digests of whole tables that depend on names, types, cells and the order of the rows, and on nothing else."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import kind, position, qcol, visible
from .identity import dense, identified

#: Digests that are hashed together into one of the next level.
WIDTH = 4_096


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row's visible cells, nulls and empty texts told apart."""
    cells = [F.coalesce(F.concat(F.lit("="), qcol(c).cast("string")), F.lit("~")) for c in visible(df)]
    return F.unhex(F.sha2(F.to_json(F.array(*cells)).cast("binary"), 256))


def _level(hashes: DataFrame) -> DataFrame:
    """(place, hash) to the same of each WIDTH of them: SHA-256 of theirs one after the other, in the order of the places."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.hex(x["hash"]))
    joined = hashes.groupBy(F.floor(F.col("place") / WIDTH).alias("place")).agg(own.alias("own"))
    return joined.select("place", F.unhex(F.sha2(F.unhex(F.array_join("own", "")), 256)).alias("hash"))


def table_digest(df: DataFrame) -> str:
    """SHA-256 over names, types and the rows in their order.

    Rows are hashed where they are and counted in their order range by range; then WIDTH hashes at a time are hashed into
    one, level by level, up to a single one. Where groups begin follows from the rows' ranks alone, so that the digest
    doesn't depend on partitions, and a task holds WIDTH hashes for each of its groups.
    """
    df = identified(df)
    hashes = df.select(position(df).alias("at"), row_hash(df).alias("hash"))
    hashes = dense(hashes, "place", [F.col("at")], start=0).select("place", "hash")
    n = rows = hashes.count()
    while n > 1:
        hashes, n = _level(hashes), -(-n // WIDTH)
    root = hashes.first()
    head = [(c, kind(df, c).simpleString()) for c in visible(df)]
    return hashlib.sha256(repr((head, rows, root["hash"].hex() if root else "")).encode()).hexdigest()
