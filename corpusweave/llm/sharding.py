"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows by a seeded hash of ``doc_id`` (of the text where the id is null) into
buckets of about ``BUCKET_BYTES`` of text, many buckets to a partition of about
``PARTITION_BYTES``. Pass two puts each bucket in a fixed order and gives its rows the places of a
Fisher-Yates shuffle: ``shuffle`` of the numbers 0 to n - 1, drawn for the bucket's count with a
seed of its own, so only numbers are held and rows just stream by in sorted order. A row's global
place is its bucket's offset plus its number; offsets come from bucket counts by a two-level
running sum. Place ``g`` goes to shard ``g mod n`` at slot ``g div n``: the law is ``rows``, so
counts are at most one apart and slots have no gaps.

The scatter ignores sources, languages and contents, so hot sources and groups of copies spread
evenly. Where one id (or null ids with one text) overfills a bucket, rows are first written to the
checkpoint folder with a random salt each, which then scatters them. Rows with null texts have size
1 and the checksum of no bytes; repeated rows each get a place of their own; columns may clash in
case and be of any type; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.frames import apart, cut, fresh

BUCKET_BYTES = 16 << 20
PARTITION_BYTES = 64 << 20
MOST_PARTITIONS = 20_000
OVERFULL = 4
GROUP = 1024


def text_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def partitions_for(size: int, least: int) -> int:
    """Partitions for ``size`` bytes, which sorts may spill: ``least`` or more, and a bounded number."""
    return max(least, min(MOST_PARTITIONS, math.ceil(size / PARTITION_BYTES)))


def shuffled(docs: DataFrame, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with one more column, ``place``: 0 to rows - 1 in a seeded uniform order."""
    rows = apart(docs, "doc_id", "text")
    total = rows.agg(F.sum(text_bytes() + 64)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    parts = partitions_for(total, min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    key = F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    counted = lambda dealt: cut(dealt.groupBy("bucket").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(text_bytes() + 64).alias("bytes"), F.max(text_bytes()).alias("longest")))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(buckets)))
    counts = counted(dealt)
    if counts.filter(F.col("bytes") - F.col("longest") > OVERFULL * bucket_bytes).limit(1).count():
        dealt = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), key, F.rand(seed)), F.lit(buckets))))
        counts = counted(dealt)

    counts = counts.withColumn("part", F.floor(F.col("bucket") / GROUP))
    sums = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = sums.selectExpr("part", "sum(part_n) OVER (ORDER BY part) - part_n AS part_start")
    starts = counts.join(before, "part").selectExpr("bucket", "part_start + sum(n) OVER (PARTITION BY part ORDER BY bucket) - n AS start", "n")
    numbers = starts.repartition(parts, "bucket").sortWithinPartitions("bucket").select("bucket", "start", F.shuffle(F.sequence(F.lit(0), F.col("n") - 1), F.lit(seed)).alias("numbers"))

    plain = [c for c, t in dealt.dtypes if c not in ("doc_id", "bucket") and "map<" not in t and "variant" not in t]
    order = Window.partitionBy("bucket").orderBy("doc_id", F.xxhash64(*plain))
    at = dealt.repartition(parts, "bucket").withColumn("at", F.row_number().over(order))
    out = at.join(numbers.hint("merge"), "bucket").select(*rows.columns, (F.col("start") + F.element_at("numbers", F.col("at"))).cast("long").alias("place"))
    return out.toDF(*docs.columns, fresh(docs, "place"))


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long) under the law ``rows``."""
    name, slot = fresh(docs, "shard"), fresh(docs, "slot")
    out = apart(shuffled(docs, seed, bucket_bytes), place := fresh(docs, "place"))
    place = F.col(place)
    return out.select(*out.columns[:-1], (place % n_shards).cast("int"), F.floor(place / n_shards).cast("long")).toDF(*docs.columns, name, slot)


def write_shards(sharded: DataFrame, path: str, files: int) -> None:
    """Writes the shards as folders ``shard=k`` of files in slot order; about ``files`` tasks share the work."""
    sharded.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
