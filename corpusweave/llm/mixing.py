"""Mixing sources to target weights with a multivariate hypergeometric splitting tree.

Sources in code-point order (null last) take the weights in turn; their shares of ``budget`` times
all words are capped at ``most`` times the source's own words and the excess is shared out again by
weight until no source is above its cap.

Each source's documents fall into hash cells by id and text: its blocks, up to ``CELLS`` of them and
fewer where sources are many. Only the words in each cell come to the driver, in Arrow columns:
sources times cells, at most ``MOST_CELLS`` numbers, never documents. A source's draws are
its whole blocks once for each full turn, and then blocks of one more permutation that still fit
its target. The counts of drawn blocks are exact quotas, which a binary tree deals to the output
shards: each node draws its left half's quotas from the multivariate hypergeometric law. A shard
then takes the next blocks of each source's permuted draws, disjoint from all other shards', and
its rows are put in a seeded random order locally.

Everything follows from the seed and the data, so reruns agree and a lost task is run again. A hot
source has as many blocks as any other, and they go to different tasks. Documents without words
belong to their block and take nothing; rows equal in ``doc_id`` and text share their draws; a null
source is a source; columns may clash in case; an empty table gives an empty result.

Beyond ``MOST_SOURCES`` sources nothing of a source comes to the driver: targets, draws and cells
are tables, with ``LEAST_CELLS`` cells a source, sources are dealt to buckets of about
``BUCKET_SOURCES``, the tree deals the buckets' quotas, and each bucket's task deals every shard's
quota among its own sources by the same law.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.llm.frames import WORD, apart, cut, fresh
from corpusweave.llm.sharding import partitions_for, text_bytes
from corpusweave.llm.textblocks import lean

WEIGHTS = (5, 2, 1)
CELLS, LEAST_CELLS = 1024, 16
MOST_CELLS = 1_000_000
MOST_SOURCES = 62_500
BUCKET_SOURCES = 10_000
BROADCAST_ROWS = 200_000
BUDGET = 1.5


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = 2.0) -> list[float]:
    """Capped shares, in the sources' order."""
    total, out = budget * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        left = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i % len(weights)] for i in free)
        share = {i: left * weights[i % len(weights)] / weight for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else share[i]
        free = free - over if over else set()
    return out


def split_quotas(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of each shard (rows) and source (columns); columns add up to ``quotas``."""
    if n_shards == 1:
        return quotas[None, :]
    left = n_shards // 2
    mine = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // n_shards, method="marginals")
    return np.concatenate([split_quotas(mine, left, rng), split_quotas(quotas - mine, n_shards - left, rng)])


@dataclass
class MixPlan:
    """Per source: words and target. ``cells``: draws (copy and shard) of each (source, cell). All on the driver, bounded."""

    sources: list[tuple[str | None, int, float]]
    cells: pa.Table
    n_cells: int
    seed: int

    def source_table(self, spark: SparkSession) -> DataFrame:
        """mix_source, source_size and target of every source."""
        return F.broadcast(spark.createDataFrame(self.sources, "mix_source string, source_size long, target double"))

    def cell_table(self, spark: SparkSession) -> DataFrame:
        """mix_source, mix_cell and draws of every cell."""
        table = spark.createDataFrame(self.cells)
        return F.broadcast(table) if len(self.cells) <= BROADCAST_ROWS else table


@dataclass
class WidePlan:
    """A ``MixPlan`` whose sources and cells are tables; they meet rows by sort and merge, where adaptive execution splits hot sources."""

    sources: DataFrame
    cells: DataFrame
    n_cells: int
    seed: int

    def source_table(self, spark: SparkSession) -> DataFrame:
        return self.sources.select("mix_source", "source_size", "target")

    def cell_table(self, spark: SparkSession) -> DataFrame:
        return self.cells


def sized(docs: DataFrame) -> DataFrame:
    """What a plan needs of ``docs``: ``doc_id``, ``source``, ``size`` in words, ``bytes`` and the text's hash."""
    return docs.select("doc_id", "source", word_count().alias("size"), text_bytes().alias("bytes"), F.xxhash64("text").alias("text_hash"))


def cell_of(n_cells: int, seed: int, text_hash="text_hash"):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), text_hash), F.lit(n_cells)).cast("int")


def draws_of(words: np.ndarray, aim: float, most: float, rng_key: list[int]) -> tuple[list[int], list[int]]:
    """One source's draws as (place of the cell, copy): whole turns over its cells, then cells of one more permutation that still fit."""
    total = int(words.sum())
    full = min(int(aim // total), int(most)) if total else 0
    left, cells, copies = aim - full * total, [], []
    for copy in range(full + 1):
        order = np.random.default_rng([*rng_key, copy]).permutation(len(words)).tolist()
        if copy < full:
            cells += order
            copies += [copy] * len(order)
        elif full < most:
            for c in order:
                if 0 < words[c] <= left:
                    cells.append(c)
                    copies.append(copy)
                    left -= int(words[c])
    return cells, copies


def make_plan(sizes: DataFrame, n_shards: int = 16, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = 2.0, seed: int = 42) -> MixPlan | WidePlan:
    """The mix of ``sizes`` (see ``sized``)."""
    n_sources = sizes.select("source").distinct().limit(MOST_SOURCES + 1).count()
    if n_sources > MOST_SOURCES:
        return wide_plan(sizes, n_shards, weights, budget, most, seed)
    n_cells = max(LEAST_CELLS, min(CELLS, MOST_CELLS // max(1, n_sources)))
    found = sizes.groupBy("source", cell_of(n_cells, seed).alias("cell")).agg(F.sum("size").alias("words")).toArrow()
    names = found["source"].unique().to_pylist()
    order = sorted(names, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(order)}
    coded = found["source"].combine_chunks().dictionary_encode(null_encoding="encode")
    of = np.array([place[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    cell, words = found["cell"].to_numpy(), found["words"].to_numpy()
    by_source = np.lexsort((cell, of))
    of, cell, words = of[by_source], cell[by_source], words[by_source]
    edges = np.searchsorted(of, np.arange(len(order) + 1))
    totals = [int(words[a:b].sum()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    aims = targets(totals, weights, budget, most)

    drawn = [draws_of(words[edges[i] : edges[i + 1]], aims[i], most, [seed, i]) for i in range(len(order))]
    shares = split_quotas(np.array([len(d[0]) for d in drawn], np.int64), n_shards, np.random.default_rng([seed, 1])) if order else np.zeros((n_shards, 0), np.int64)
    at = np.concatenate([np.zeros(0, np.int64), *(np.array(d[0], np.int64) + edges[i] for i, d in enumerate(drawn))])
    copy = np.concatenate([np.zeros(0, np.int32), *(np.array(d[1], np.int32) for d in drawn)])
    shard = np.concatenate([np.zeros(0, np.int32), *(np.repeat(np.arange(n_shards, dtype=np.int32), shares[:, i]) for i in range(len(order)))])
    grouped = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[grouped], np.arange(len(cell) + 1)).astype(np.int32)
    draws = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(copy[grouped]), pa.array(shard[grouped])], ["copy", "shard"]))
    sources = pa.array(order, pa.string()).take(pa.array(of))
    cells = pa.table({"mix_source": sources, "mix_cell": pa.array(cell, pa.int32()), "draws": draws})
    return MixPlan(list(zip(order, totals, aims, strict=True)), cells, n_cells, seed)


def wide_targets(sizes: DataFrame, weights: tuple, budget: float, most: float, seed: int) -> DataFrame:
    """Per source: its place in the order, words, target, and its ``cells`` (cell, words) in order."""
    cells = sizes.groupBy("source", cell_of(LEAST_CELLS, seed).alias("cell")).agg(F.sum("size").alias("words"))
    each = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sort_array(F.collect_list(F.struct("cell", "words"))).alias("cells"))
    order = [F.col("source").isNull(), F.col("source")]
    width = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(each.repartitionByRange(width, *order).withColumn("range", F.spark_partition_id()))
    before, counts = 0, sorted(map(tuple, dealt.groupBy("range").count().collect()))
    offsets = []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offsets = F.broadcast(sizes.sparkSession.createDataFrame(offsets, "range int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    ranked = dealt.join(offsets, "range").withColumn("place", place)
    ranked = cut(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).drop("range", "before"))
    total, share, capped = budget * (ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        over = F.lit(share) * F.col("weight") > most * F.col("source_size")
        n, full, weight = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not weight:
            break
        capped, share = n, (total - most * (full or 0)) / weight
    return ranked.withColumn("target", F.when(over, most * F.col("source_size")).otherwise(F.lit(share) * F.col("weight")))


def wide_plan(sizes: DataFrame, n_shards: int, weights: tuple, budget: float, most: float, seed: int) -> WidePlan:
    """The mix of any number of sources, in tables."""
    spark = sizes.sparkSession
    sources = cut(wide_targets(sizes, weights, budget, most, seed).withColumnRenamed("source", "mix_source"))
    n_buckets = min(MOST_SOURCES, math.ceil(sources.count() / BUCKET_SOURCES))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, aims, cells = (batch.column(k).to_pylist() for k in (1, 2, 3))
            drawn = [draws_of(np.array([c["words"] for c in some], np.int64), aim, most, [seed, place]) for place, aim, some in zip(places, aims, cells, strict=True)]
            listed = lambda k: pa.array([d[k] for d in drawn], pa.list_(pa.int32()))
            numbers = pa.array([[c["cell"] for c in some] for some in cells], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p % n_buckets for p in places], pa.int32()), numbers, listed(0), listed(1)], ["mix_source", "place", "bucket", "cells", "at", "copies"])

    drawn = cut(sources.select("mix_source", "place", "target", "cells").mapInArrow(lean(draw), "mix_source string, place long, bucket int, cells array<int>, at array<int>, copies array<int>"))
    quotas = sorted(map(tuple, drawn.groupBy("bucket").agg(F.sum(F.size("at"))).collect()))
    shares = split_quotas(np.array([n for _, n in quotas], np.int64), n_shards, np.random.default_rng([seed, 1]))
    by_bucket = spark.createDataFrame([(b, shares[:, i].tolist()) for i, (b, _) in enumerate(quotas)], "bucket int, shares array<long>")

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        at, copies, cells = (table[c].to_pylist() for c in ("at", "copies", "cells"))
        left = np.array(list(map(len, at)), np.int64)
        rng = np.random.default_rng([seed, 1, table["bucket"][0].as_py()])
        taken = np.zeros((n_shards, len(left)), np.int64)
        for shard, quota in enumerate(table["shares"][0].as_py()):
            taken[shard] = rng.multivariate_hypergeometric(left, quota, method="marginals")
            left -= taken[shard]
        names, numbers, draws = [], [], []
        for i, source in enumerate(table["mix_source"].to_pylist()):
            own: list[list[dict]] = [[] for _ in cells[i]]
            for c, copy, shard in zip(at[i], copies[i], np.repeat(np.arange(n_shards), taken[:, i]).tolist(), strict=True):
                own[c].append({"copy": copy, "shard": shard})
            names += [source] * len(own)
            numbers += cells[i]
            draws += own
        kind = pa.list_(pa.struct([("copy", pa.int32()), ("shard", pa.int32())]))
        return pa.table({"mix_source": pa.array(names, pa.string()), "mix_cell": pa.array(numbers, pa.int32()), "draws": pa.array(draws, kind)})

    dealt = drawn.join(F.broadcast(by_bucket), "bucket").groupBy("bucket").applyInArrow(deal, "mix_source string, mix_cell int, draws array<struct<copy:int,shard:int>>")
    return WidePlan(sources, cut(dealt), LEAST_CELLS, seed)


def with_draws(df: DataFrame, plan: MixPlan | WidePlan, text_hash="text_hash") -> DataFrame:
    """``df`` with ``draws``: for each copy of the row that the mix takes, its number and shard."""
    table = plan.cell_table(df.sparkSession).withColumnRenamed("draws", fresh(df, "draws"))
    on = F.col("source").eqNullSafe(F.col("mix_source")) & (cell_of(plan.n_cells, plan.seed, text_hash) == F.col("mix_cell"))
    return df.join(table, on, "left").drop("mix_source", "mix_cell")


def mix(docs: DataFrame, n_shards: int = 16, seed: int = 42, **shares) -> DataFrame:
    """The mixed rows of ``docs``: its columns, then ``copy`` and ``shard``, each shard's rows in random order.

    A shard is dealt out at random over tasks whose number follows the bytes; each sorts its part by a random key.
    """
    rows = apart(docs, "doc_id", "source", "text")
    sizes = cut(sized(rows))
    drawn = with_draws(rows, make_plan(sizes, n_shards, seed=seed, **shares), F.xxhash64("text"))
    size = sizes.agg(F.sum("bytes")).first()[0] or 0
    pieces = -(-partitions_for(int(shares.get("budget", BUDGET) * size), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) // n_shards)
    out = drawn.select(*rows.columns, F.explode("draws").alias("draw")).select(*rows.columns, F.col("draw.copy").alias("copy"), F.col("draw.shard").alias("to"))
    key = F.xxhash64(F.lit(seed), "to", "copy", "doc_id", F.xxhash64("text"))
    dealt = out.repartition(n_shards * pieces, F.col("to"), F.pmod(F.shiftright(key, 20), F.lit(pieces))).sortWithinPartitions("to", key)
    return dealt.toDF(*docs.columns, fresh(docs, "copy"), fresh(docs, "shard"))
