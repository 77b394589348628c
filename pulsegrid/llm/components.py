"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(rest)


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link only and is no smaller end: each is linked to the smallest node it reaches."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("_e")).select("_e.*")
    met = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return not met.where("ups > 0 AND n > 1").agg(F.count("*")).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that a link to another node names; root is the smallest node it reaches.

    Links with a null end or two equal ends add nothing; repeated links count once. Hot nodes are safe: minima are
    aggregated before the shuffle and the joins can be split. Each half of a round is written to the shared folder, so that
    plans and lineage stay short; the loop ends as soon as all links form stars, which is seen without a further round.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    edges = settle(edges, "edges")
    while not _stars(edges):
        edges = settle(_large_star(edges).distinct(), "edges")
        edges = settle(_small_star(edges).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """components() of the links that roots (node, root) come from and of more (a, b), which is written and read again; without any more, roots as they are."""
    if not more.limit(1).count():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
