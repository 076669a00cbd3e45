"""Connected components of links in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links``.

    ``links`` has columns a and b (integers); nulls and loops are ignored. Alternates
    two steps until nothing changes: every node hands its larger neighbours to the
    smallest, then its smaller ones. Each step is a grouped minimum and a join, so a
    node with very many links is reduced before the shuffle and split in the join.
    Rounds grow with the logarithm of the longest path; each is written as a table.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a > b")
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = materialize(
            small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a > b")
            .distinct()
        )
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
