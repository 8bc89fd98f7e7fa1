"""Discovery over landed pages: breadcrumb descent, manifests and what is left to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.catalog import shared_folder

DEEPEST = 8


def _cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def descend(pages: DataFrame, roots: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(url, depth) of pages reachable from ``roots`` (url) by links to exactly one crumb deeper.

    Roots count whatever their crumbs. One join a level; each level is checkpointed, so plans
    stay short, and a page counts at its least depth.
    """
    known = pages.select("url", "breadcrumb", "links")
    level = _cut(roots.select("url").distinct().join(known, "url").withColumn("depth", F.lit(0)))
    found = level.select("url", "depth")
    for depth in range(1, deepest + 1):
        step = level.select(F.col("breadcrumb").alias("above"), F.explode("links").alias("url")).distinct()
        child = step.join(known, "url").filter((F.size("breadcrumb") == F.size("above") + 1) & (F.slice("breadcrumb", F.lit(1), F.greatest(F.size("above"), F.lit(0))) == F.col("above")))
        level = _cut(child.select("url", "breadcrumb", "links").dropDuplicates(["url"]).join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not level.limit(1).count():
            break
        found = _cut(found.unionByName(level.select("url", "depth")))
    return found


def extends(parent, child):
    """Whether a child's crumbs begin with the parent's, or either is empty: the older, laxer rule."""
    return (F.size(parent) == 0) | (F.size(child) == 0) | (F.slice(child, F.lit(1), F.size(parent)) == parent)


def merge_manifest(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by URL; the new ones win."""
    return prior.join(new.select("url"), "url", "left_anti").unionByName(new.dropDuplicates(["url"]))


def category_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


def to_fetch(manifest: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Manifest rows without a landed page."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")
