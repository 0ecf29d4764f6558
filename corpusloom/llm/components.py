"""Connected components of an edge table, without ever gathering it in one place.

Alternating large-star and small-star steps (Kiveris et al. 2014): every round is two
equi-joins with a pre-aggregated minimum, so a vertex with very many neighbours costs
rows, not pairs.  Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each vertex's larger (or smaller) neighbours to the least vertex of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(vertex, component) for every vertex with an edge; the component is its least vertex.

    ``edges`` has columns u and v of one orderable type; loops and repeats do no harm.
    An empty table has no vertices.  Raises if ``rounds`` do not suffice (each at least
    halves the remaining distance, so this takes a path longer than 2**rounds).
    """
    now = checkpointed(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(rounds):
        now = checkpointed(_star(_star(now, True), False))
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
        before = mark
    raise RuntimeError("components: the rounds did not suffice")
