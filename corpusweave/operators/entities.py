"""Gazetteers, phrase tagging and tag hygiene.

Tagging is an equi-join of texts' word n-grams with the gazetteer's phrases; the n-grams are those
of the lengths that the gazetteer has, and only rows whose n-gram is a phrase survive the join. A
gazetteer of up to ``BROADCAST_NAMES`` names is broadcast, a larger one is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusweave.functions.text import slug_name, strip

# Fixed values.
MIN_NAME, MOST_ENTITIES = 3, 30
NAME_STOPS = ("map", "the", "and", "lore", "boss", "bosses", "npc", "npcs", "item", "items", "weapon", "weapons", "armor", "shield", "shields", "spell", "spells", "location", "locations", "enemy", "enemies", "guide", "notes", "note")
GLOBAL_STOPS = ("World Information", "Equipment & Magic", "Equipment", "Items", "Creatures and Enemies", "Guides & Walkthroughs", "Key Items", "Armor", "Weapons", "NPCs", "Bosses", "Locations", "Skills", "Magic")
STAT_STOPS = ("Str", "Dex", "Int", "Fai", "Arc", "Strength", "Dexterity", "Intelligence", "Faith", "Arcane", "Fire", "Light", "Holy", "Lightning", "Physical", "Magic", "Slash", "Strike", "Pierce", "Standard", "Combat", "Death", "HP", "FP", "Info", "Page", "Skill")
BROADCAST_NAMES = 200_000
TOKEN = r"[A-Za-z0-9']+"


def gazetteer_names(pages: DataFrame) -> DataFrame:
    """Names from ``title`` and the slugs of ``links``: long enough, not stopped, distinct, sorted."""
    titles = pages.select(strip(F.col("title")).alias("name"))
    slugs = pages.select(F.explode("links").alias("link")).select(slug_name(F.col("link")).alias("name"))
    names = titles.unionAll(slugs).filter((F.length("name") >= MIN_NAME) & ~F.lower("name").isin(*NAME_STOPS))
    return names.distinct().orderBy("name")


def frequencies(chunks: DataFrame, column: str = "entities") -> DataFrame:
    """How many tags each name has over all chunks."""
    return chunks.select(F.explode(column).alias("name")).select(F.trim("name").alias("name")).filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("freq"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, n: Column) -> Column:
    """All runs of ``n`` words, joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def tag(texts: DataFrame, gazetteer: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entities): names whose words follow each other in the text, without case; sorted."""
    phrases = gazetteer.select("name", F.array_join(tokens(F.col("name")), " ").alias("phrase"), F.size(tokens(F.col("name"))).alias("words")).filter("words > 0")
    phrases = phrases.groupBy("phrase", "words").agg(F.min("name").alias("name"))
    lengths = sorted(r[0] for r in phrases.select("words").distinct().collect())
    if phrases.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        phrases = F.broadcast(phrases)
    split = texts.select(key, tokens(F.col(text)).alias("tokens"))
    runs = F.array_distinct(F.concat(*(ngrams(F.col("tokens"), F.lit(n)) for n in lengths))) if lengths else F.array().cast("array<string>")
    found = split.select(key, F.explode(runs).alias("phrase")).join(phrases, "phrase")
    return found.groupBy(key).agg(F.sort_array(F.collect_set("name")).alias("entities"))


def with_tags(texts: DataFrame, gazetteer: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``texts`` with ``entities`` as of ``tag``; a gazetteer of up to ``BROADCAST_NAMES`` names is matched row by row, without a join."""
    phrases = gazetteer.select("name", F.array_join(tokens(F.col("name")), " ").alias("phrase")).filter("phrase <> ''").groupBy("phrase").agg(F.min("name").alias("name"))
    some = phrases.limit(BROADCAST_NAMES + 1).toArrow()
    if len(some) > BROADCAST_NAMES:
        return texts.join(tag(texts, gazetteer, key, text), key, "left")
    known = dict(zip(some["phrase"].to_pylist(), some["name"].to_pylist(), strict=True))
    starts: dict[str, set[int]] = {}
    for p in known:
        starts.setdefault(p.split(" ")[0], set()).add(p.count(" ") + 1)
    shipped = texts.sparkSession.sparkContext.broadcast((known, starts))

    @F.pandas_udf("array<string>")
    def found(words: pd.Series) -> pd.Series:
        name_of, lengths = (x.get for x in shipped.value)
        return pd.Series([sorted({name for i, x in enumerate(w) for n in lengths(x, ()) if (name := name_of(" ".join(w[i : i + n])))}) for w in map(str.split, words)])

    return texts.withColumn("entities", found(F.array_join(tokens(F.coalesce(F.col(text), F.lit(""))), " ")))


def denoise(entities: Column, breadcrumb: Column, title: Column, site: str = "") -> Column:
    """Without stopped names, breadcrumb nodes and all-lower-case words; the page's own title in front."""
    stops = F.array(*map(F.lit, dict.fromkeys((*GLOBAL_STOPS, *STAT_STOPS, *([site] if site else [])))))
    lower_only = lambda e: (F.lower(e) == e) & e.rlike(r"\p{L}")
    kept = F.filter(entities, lambda e: ~F.array_contains(stops, e) & ~F.array_contains(breadcrumb, e) & ~lower_only(e))
    add = (F.coalesce(title, F.lit("")) != "") & ~F.array_contains(kept, title) & ~title.isin(*GLOBAL_STOPS, *([site] if site else []))
    return F.when(add, F.concat(F.array(title), kept)).otherwise(kept)


def cap(entities: Column, most: int = MOST_ENTITIES) -> Column:
    return F.slice(entities, 1, most)
