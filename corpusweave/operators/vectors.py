"""Vector tables: embedding, sanity checks, reuse of earlier vectors, keyed upserts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
ZERO_NORM, NORM_SLACK = 1e-6, 0.01


class HashEmbedder:
    """A deterministic stand-in for a model: hashed bag of words, unit length. It carries no meaning."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.dim] += 1.0 if h >> 32 & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


def embed(chunks: DataFrame, embedder=None, text: str = "text") -> DataFrame:
    """``chunks`` with ``vector``; the embedder is made once a task and sees Arrow batches."""
    embedder = embedder or HashEmbedder()
    schema = chunks.withColumn("vector", F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=embedder.encode(batch[text].tolist()))

    return chunks.mapInPandas(run, schema)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def sanity(vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """One row: counts of bad vectors, id collisions, norms, and whether all is well."""
    v, n = F.col(vector), norm(F.col(vector))
    found = vectors.agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size(v)).alias("dim"),
        F.count_if(F.exists(v, lambda x: F.isnan(x))).alias("nan_rows"),
        F.count_if(F.exists(v, lambda x: F.abs(x) == float("inf"))).alias("inf_rows"),
        F.count_if(n < ZERO_NORM).alias("zero_rows"), F.count_distinct(key).alias("n_ids"),
        F.round(F.min(n), 4).alias("min_norm"), F.round(F.max(n), 4).alias("max_norm"),
    )
    good = (F.col("nan_rows") + F.col("inf_rows") + F.col("zero_rows") == 0) & (F.col("n_ids") == F.col("n_rows"))
    off = (F.col("min_norm") < 1 - NORM_SLACK) | (F.col("max_norm") > 1 + NORM_SLACK)
    return found.withColumns({"collisions": F.col("n_rows") - F.col("n_ids"), "passed": good, "norm_warning": off})


def reuse(current: DataFrame, old: DataFrame, changed: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``current`` with the value of ``changed``, else of ``old``; among repeated keys the last by ``order`` counts. ``origin`` says which, or missing."""
    last = lambda df, name: df.groupBy(key).agg(F.max_by(value, order).alias(name))
    joined = current.join(last(changed, "_new"), key, "left").join(last(old, "_old"), key, "left")
    origin = F.when(F.col("_new").isNotNull(), "new").when(F.col("_old").isNotNull(), "reused").otherwise("missing")
    return joined.withColumns({value: F.coalesce("_new", "_old"), "origin": origin}).drop("_new", "_old")


def require_complete(merged: DataFrame) -> DataFrame:
    """``merged``, or an error when a row has no value."""
    missing = merged.filter("origin = 'missing'").count()
    if missing:
        raise ValueError(f"{missing} rows have no vector")
    return merged


def missing_rows(chunks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't done yet."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of ``base`` that ``batch`` doesn't replace, and the last of each key of ``batch``.

    The batch's keys are pre-aggregated; the base is read once and never windowed.
    """
    columns = [c for c in base.columns]
    latest = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")
    return base.join(latest.select(key), key, "left_anti").unionByName(latest.select(*columns))
