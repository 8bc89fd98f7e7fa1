"""Mentions to names: fuzzy scores, frequency ties, shortlists and their binding.

The mentions are a query set: their distinct texts meet the gazetteer in broadcast blocks of
``BROADCAST_MENTIONS``, while the gazetteer stays spread out. Names below the floor are dropped in
the task that scores them, so only possible answers are shuffled; they change no shortlist, as any
name above the floor ranks before them and a best score below it leaves the shortlist empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.similarity import composite_score

SHORTLIST, FLOOR, TIE_BAND = 5, 60.0, 5.0
BROADCAST_MENTIONS = 100_000


def scored(mentions: DataFrame, gazetteer: DataFrame, score: Column | None = None, floor: float = FLOOR) -> DataFrame:
    """(mention, name) pairs of ``floor`` or more with their score."""
    distinct = mentions.select(F.trim("mention").alias("mention")).filter("mention <> ''").distinct()
    blocks = -(-distinct.count() // BROADCAST_MENTIONS) or 1
    block = lambda k: distinct.filter(F.pmod(F.xxhash64("mention"), F.lit(blocks)) == k) if blocks > 1 else distinct
    value = composite_score("mention", "name") if score is None else score
    pairs = [gazetteer.crossJoin(F.broadcast(block(k))).withColumn("score", value).filter(F.col("score") >= floor) for k in range(blocks)]
    return reduce(DataFrame.unionAll, pairs)


def ranked(pairs: DataFrame) -> DataFrame:
    """``rank`` by mention: names within the band of the best by frequency, then the others by score."""
    by = Window.partitionBy("mention")
    banded = pairs.withColumn("in_band", F.max("score").over(by) - F.col("score") <= TIE_BAND)
    order = [F.desc("in_band"), F.desc(F.when(F.col("in_band"), F.col("freq").cast("double")).otherwise(F.col("score"))), F.desc("score"), F.desc("freq"), F.asc("name")]
    return banded.withColumn("rank", F.row_number().over(by.orderBy(*order)))


def shortlist(pairs: DataFrame, most: int = SHORTLIST, floor: float = FLOOR) -> DataFrame:
    """Up to ``most`` names a mention that reach the floor, in rank order."""
    kept = ranked(pairs).filter(F.col("score") >= floor)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("mention").orderBy("rank"))).filter(F.col("rank") <= most)


def accepted(short: DataFrame) -> DataFrame:
    """Each mention's first name, its gap to the second, and whether it needs no choice."""
    by = Window.partitionBy("mention").orderBy("rank")
    first = short.withColumn("gap", F.coalesce(F.col("score") - F.lead("score").over(by), F.lit(100.0))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mention"))).filter("rank = 1")
    sure = (F.col("n") == 1) | ((F.col("score") >= 95) & (F.col("gap") >= 5)) | ((F.col("score") >= 90) & (F.col("gap") >= 10))
    return first.select("mention", "name", "score", "gap", sure.alias("accepted"))
