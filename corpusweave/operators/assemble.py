"""Context, source cards and images from ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.functions.text import context_block, norm_text
from corpusweave.operators.retrieve import keep_first

CONTEXT_CHARS = 12_000
MIN_CONTRIBUTION, STRONG_SCORE, MOST_IMAGES = 2, 0.74, 4
# Titles with one of these are no visual subjects.
NON_VISUAL = (
    "stats", "comparison", "calculating", "motion values", "damage", "status effects", "poise", "hemorrhage", "skills",
    "level", "hp", "upgrades", "patch notes", "controls", "builds", "walkthrough", "route", "progress route",
    "game progress", "bosses", "items", "locations", "weapons", "npcs", "npc", "armor", "shields", "sorceries",
    "incantations", "talismans", "ashes of war", "spells", "endings", "great runes", "spirit ashes", "crystal tears",
    "cookbooks", "creatures", "merchants", "daggers", "straight swords", "greatswords", "colossal swords",
    "colossal weapons", "thrusting swords", "heavy thrusting swords", "curved swords", "curved greatswords", "katanas",
    "twinblades", "axes", "greataxes", "hammers", "great hammers", "flails", "spears", "great spears", "halberds",
    "reapers", "whips", "fists", "bows", "light bows", "greatbows", "crossbows", "ballistae", "glintstone staffs",
    "glintstone staves", "sacred seals", "torches", "throwing blades",
)


def budgeted(blocks: Column, most: int = CONTEXT_CHARS) -> Column:
    """Blocks in order, passing over each that would exceed the budget; separators don't count."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda a, b: a["used"] + F.length(b) <= most
    return F.aggregate(
        blocks, start,
        lambda a, b: F.struct(F.when(fits(a, b), a["used"] + F.length(b)).otherwise(a["used"]).alias("used"), F.when(fits(a, b), F.concat(a["kept"], F.array(b))).otherwise(a["kept"]).alias("kept")),
        lambda a: a["kept"],
    )


def context(ranked: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """One row: the context text of chunks in rank order."""
    rows = ranked.agg(F.sort_array(F.collect_list(F.struct("rank", context_block(F.col("title"), F.col("section_heading"), F.col("raw_text")).alias("block")))).alias("rows"))
    kept = budgeted(F.transform("rows", lambda r: r["block"]), most)
    return rows.select(F.when(F.size("rows") == 0, F.lit("(no passages were retrieved)")).otherwise(F.array_join(kept, "\n\n")).alias("context"))


def named_in(title: Column, answer: str | None) -> Column:
    """Whether the answer names the title, both normalised."""
    low = norm_text(F.lit(answer or ""))
    return (norm_text(title) != "") & F.contains(low, norm_text(title))


def sources(ranked: DataFrame, entities: tuple[str, ...] = (), answer: str | None = None) -> DataFrame:
    """One card a page in rank order; with an answer, only pages of the entities or named in it."""
    cards = ranked
    if answer:
        cards = cards.filter(F.lower("title").isin([e.lower() for e in entities]) | named_in(F.col("title"), answer))
    first = keep_first(cards, "url", [F.asc("rank")])
    return first.orderBy("rank").select("title", "url", F.col("section_heading").alias("section"), F.nullif("image_url", F.lit("")).alias("image_url"), "category")


def is_visual(title: Column) -> Column:
    return ~F.lower(title).rlike("|".join(NON_VISUAL))


def images(ranked: DataFrame, entities: tuple[str, ...] = (), answer: str | None = None, most: int = MOST_IMAGES) -> DataFrame:
    """Pages' images: entity pages, then pages named in the answer, by best score and number of chunks."""
    own = F.lower("title").isin([e.lower() for e in entities]) if entities else F.lit(False)
    named = named_in(F.col("title"), answer) if answer else F.lit(False)
    used = F.when(F.col("boost") != 0, F.col("final_score")).otherwise(F.col("score"))
    seen = ranked.filter((F.coalesce("image_url", F.lit("")) != "") & is_visual(F.col("title"))).withColumns({"used": used, "own": own, "named": named})
    pages = seen.groupBy("url").agg(
        F.min_by("image_url", "rank").alias("image_url"), F.min_by("title", "rank").alias("title"), F.min("rank").alias("first"),
        F.count(F.lit(1)).alias("count"), F.max("used").alias("best"), F.min_by("own", "rank").alias("own"), F.min_by("named", "rank").alias("named"),
    )
    earned = (F.col("count") >= MIN_CONTRIBUTION) | (F.col("best") >= STRONG_SCORE)
    pages = pages.filter(F.col("own") | (earned & F.col("named")) if answer else F.col("own") | earned)
    order = [F.desc("own"), F.desc("named"), F.desc("best"), F.desc("count"), F.asc("first")]
    return keep_first(pages, "image_url", order).orderBy(*order).limit(most).select("image_url", "title", "url")


def answer_stats(ranked: DataFrame) -> DataFrame:
    """Number of chunks and pages, top titles and scores."""
    top = F.slice(F.sort_array(F.collect_list(F.struct("rank", "title", F.round("final_score", 4).alias("score")))), 1, 3)
    return ranked.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("url").alias("n_pages"), F.transform(top, lambda t: t["title"]).alias("top_titles"), F.transform(top, lambda t: t["score"]).alias("top_scores"))


def top_k_rank(order: list) -> Column:
    return F.row_number().over(Window.orderBy(*order))
