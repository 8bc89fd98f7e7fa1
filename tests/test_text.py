"""Worked examples of the text functions."""

import pytest
from pyspark.sql import functions as F

from corpusweave.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("out")).first()[0]


@pytest.mark.parametrize(("heading", "title", "want"), [("Wiki Milady Notes & Tips", "Milady", "Notes & Tips"), ("Milady: Stats", "Milady", "Stats"), ("Milady", "Milady", "Overview"), ("Wiki - Lore", "X", "Lore"), (" Combat ", "X", "Combat")])
def test_headings(spark, heading, title, want):
    assert one(spark, X.clean_heading(F.col("h"), F.col("t"), "Wiki"), h=heading, t=title) == want


def test_prefix(spark):
    column = X.context_prefix(F.col("b"), F.col("t"), F.col("s"))
    assert one(spark, column, b=["World Information", "Locations"], t="Caelid", s="Bosses") == "[World Information / Locations / Caelid · Bosses]"
    assert one(spark, column, b=[], t="Caelid", s="overview") == "[Caelid]"
    assert one(spark, column, b=[""], t="Caelid", s="CAELID") == "[Caelid]"


def test_slug_and_ids(spark):
    assert one(spark, X.slug_name(F.col("u")), u="https://w.example/Starscourge+Radahn/") == "Starscourge Radahn"
    assert one(spark, X.slug_name(F.col("u")), u="https://w.example/A%27s+Set") == "A's Set"
    assert str(one(spark, X.point_id(F.col("c")), c="ffffffffffffffff")) == "18446744073709551615"


@pytest.mark.parametrize(("key", "value", "want"), [("ScalingStrDDexC", "x", True), ("Wgt.6.5", "Passive-", True), ("FP Cost", "FP9", False), ("FP Cost", "FP8 ( - 12)", False)])
def test_mashed(spark, key, value, want):
    from corpusweave.operators.html import is_mashed

    assert one(spark, X.is_mashed(F.col("k"), F.col("v")), k=key, v=value) is want
    assert is_mashed(key, value) is want


def test_sections(spark):
    found = one(spark, X.sections(F.col("b")), b="intro\nmore\n## Drops\nA\nB\n## Empty\n\n## Lore\nC")
    assert [(s["heading"], s["content"]) for s in found] == [("Overview", "intro\nmore"), ("Drops", "A\nB"), ("Lore", "C")]
    assert one(spark, X.sections(F.col("b")), b="") == []


@pytest.mark.parametrize(("said", "want"), [("yes please", True), ("Sure, go ahead", True), ("ok so how do I", False), ("go to Leyndell", False), ("", False), ("that sounds good and more words", False)])
def test_affirmation(spark, said, want):
    from corpusweave.plans.retrieval import is_affirmation

    assert one(spark, X.is_affirmation(F.col("x")), x=said) is want
    assert is_affirmation(said) is want


def test_superlatives(spark):
    for said, sort, group in (("heaviest armor", "weight_desc", "Armor"), ("the CHEAPEST sorcery?", "fp_cost_asc", "Sorceries"), ("lightest katana", "weight_asc", "Weapons"), ("best bow", None, None)):
        assert (one(spark, X.superlative_sort(F.col("x")), x=said), one(spark, X.superlative_group(F.col("x")), x=said)) == (sort, group)


def test_urls(spark):
    base = "https://w.example"
    for href, want in (("//a.b/c/", "https://a.b/c"), ("/Page#top", "https://w.example/Page"), ("mailto:x", None), ("#top", None), ("https://w.example/", "https://w.example")):
        assert one(spark, X.absolute(F.col("h"), base), h=href) == want
    for url, want in (("https://w.example/Page", True), ("https://w.example/a.PNG", False), ("https://x.example/Page", False), ("https://w.example/Page?x=1", False), ("https://w.example", False), ("https://w.example/file/x", False), ("https://w.example/Maps", False)):
        assert one(spark, X.content_url(F.col("u"), "w.example", ("/Maps",)), u=url) is want


def test_category(spark):
    column = X.category(F.col("b"), F.lit("none"))
    assert one(spark, column, b=["Weapons", "Bosses of Caelid"]) == "boss"
    assert one(spark, column, b=["Weapons", "Moonveil"]) == "item"
    assert one(spark, column, b=[]) == "none"


def test_cleaning(spark):
    assert one(spark, X.normalise(F.col("x")), x="\xa0 a\t\t b\n\n\n\nc \n") == "a b\n\nc"
    assert one(spark, X.drop_adjacent(X.sentences(F.col("x"))), x="One. one. Two! Two! One.") == ["One.", "Two!", "One."]
    assert one(spark, X.without_follow_up(F.col("x")), x="What does he drop (follow up question)") == "What does he drop"
    assert one(spark, X.phonetic_skeleton(F.col("x")), x="Malenia") == one(spark, X.phonetic_skeleton(F.col("x")), x="Melania")
    assert one(spark, X.norm_quotes(F.col("x")), x="Radagon’s,  Soreseal") == "radagon's soreseal"
