"""Connected components of a graph by alternating large-star and small-star rounds.

Edges are pairs of longs. Each round is two aggregations and joins; the driver sees one number a
round, whether anything changed. Rounds are written to the shared checkpoint folder, so a lost
executor costs the current round at most. The number of rounds grows with the logarithm of the
largest component. Minimums are pre-aggregated, so a hub's many edges never meet in one task to
find it; the join that follows them is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.frames import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges ``a`` > ``b``."""
    if large:
        pairs = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = pairs.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (a, b); smallest nodes themselves are left out."""
    current = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())

    before = state(current)
    while before[0]:
        current = cut(_star(_star(current, True), False))
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
