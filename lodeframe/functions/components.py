"""Connected components of a graph given by its links, by alternating large-star and small-star rounds.

After each round the links are a written table. A vertex with a large share of all links is only a join key, whose
partitions Spark splits at run time; no neighbourhood is collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def _hooked(links: DataFrame) -> DataFrame:
    """Each link (u, v) with least, the smallest of u and all its neighbours v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hooked(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links with u > v."""
    hooked = _hooked(links)
    return (
        hooked.select(F.col("v").alias("u"), F.col("least").alias("v"))
        .unionByName(hooked.select("u", F.col("least").alias("v")))
        .where(F.col("u") > F.col("v"))
    )


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of longs, u and v. Returns (u, v): each vertex that isn't the smallest of its
    component, and the smallest. Takes about log(vertices) rounds."""
    links = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    links, before = stored(links.distinct(), "links"), None
    while True:
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        ).first()
        if state == before or not state["n"]:
            return links
        before = state
        links = stored(_small_star(_large_star(links).distinct()).distinct(), "links")
