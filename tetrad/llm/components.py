"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tetrad.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest
    node of its component.

    Alternating large-star and small-star steps: each replaces the links by ones
    to the smallest neighbour, so a component becomes a star in a few rounds. A
    node of many links is never gathered: its smallest neighbour is an
    aggregate, joined back to its links.
    """
    def least(pairs):
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def large_star(links):
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")) \
            .union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        return both.join(least(both), "u").filter("v > u and v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))

    def small_star(links):
        down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        m = least(down)
        moved = down.join(m, "u").filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return moved.union(m.select(F.col("m").alias("a"), F.col("u").alias("b")))

    def tidy(links):
        return links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links = materialize(tidy(links), "links")
    while True:
        new = materialize(tidy(small_star(tidy(large_star(links)))), "links")
        # equal link sets: as many, and none is new
        if new.count() == links.count() and new.join(links, ["a", "b"], "left_anti").isEmpty():
            break
        links = new
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")) \
        .union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
