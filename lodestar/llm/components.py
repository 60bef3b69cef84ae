"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def starred(links: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b), a > b, that connect the same nodes as the undirected links (a, b), and (node, component), both stored.

    At the end the edges are stars around the smallest node of each component.
    After ``rounds`` rounds, if these come first, they need not be: then a
    component may have several names, each that of a node connected with
    those that bear it, and the edges may be handed in again with more links.

    Each round is two joins of tables in the shared folder, so a node with
    very many links is split by adaptive execution instead of meeting in one
    task, and nothing is collected but the round's count of nodes outside
    stars.  Links with a null end and links of a node with itself are left
    out; no links give an empty result.  A round's tables are deleted at its
    end.
    """
    both = lambda e: e.select("a", "b").union(e.select("b", "a"))
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "cc")
    done = 0
    while True:
        # large star: every larger neighbour of a goes to the smallest of a and its neighbours
        high = both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both(edges).join(high, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b"), "cc-large")
        # small star: a and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stored(small.union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "cc")
        # a node with two names is not in a star yet
        names = small.union(small.select("b", "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"), F.max("b").alias("other"))
        names = stored(names, "cc-names")
        done += 1
        end = done == rounds or not names.where("component != other").count()
        released(edges.sparkSession, edges, large, *([] if end else [names]))
        edges = small
        if end:
            return edges, names.select("node", "component")
