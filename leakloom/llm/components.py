"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leakloom.llm.common import stored

#: Links of one partition: a table of no more is too small to be dealt out anew in every round.
LINKS = 100_000


def _same(one: DataFrame, other: DataFrame) -> bool:
    """Whether two stored tables of distinct (u, v) hold the same rows, by their number and 128 bits of them."""
    marks = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))]
    return one.agg(*marks).first() == other.agg(*marks).first()


def components(links: DataFrame, few: int = LINKS) -> DataFrame:
    """Stored (node, root) of every node in `links` (a, b); root is the smallest node it reaches.

    Each round points the larger neighbours of a node to its smallest one, then the
    smaller ones, until nothing moves. Minima are combined before the shuffle and
    joins are plain equi-joins, so a node with very many links is no bottleneck.
    `links` is read twice: pass a stored table. One of up to `few` rows stays in one
    partition, where a round needs no shuffle; a larger one is shuffled.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    small_table = edges.count() <= few

    def kept(df: DataFrame) -> DataFrame:
        return df.coalesce(1) if small_table else df

    edges = kept(stored(kept(edges).distinct(), "component-links"))
    while True:
        both = kept(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = kept(stored(large.distinct(), "component-large"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = kept(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))))
        after = kept(stored(after.where("u != v").distinct(), "component-small"))
        if _same(edges, after):
            break
        edges = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = kept(roots.unionByName(roots.select(F.col("root").alias("node"), "root")))
    return stored(roots.distinct(), "components")
