"""Queries of page parsing over made-up pages, of file round trips and of plan rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave import config
from corpusweave.catalog import scratch_path, spread, table
from corpusweave.operators.html import parsed
from corpusweave.registry import register
from corpusweave.sources import collections, files

BASE, HOST = "https://w.example", "w.example"
PAGE = (
    '<div id="breadcrumbs-container"><a href="/E">Equipment</a><a href="/W">Weapons</a><a href="#">+</a></div><h1 id="page-title">{name} | Wiki</h1><script>bad</script><div id="wiki-content-block">'
    '<table class="wiki_table"><tr><td>Kind</td><td>{type}</td></tr><tr><td>Scaling<div class="lineleft"><a>Str</a> C <a>Dex</a> -</div></td></tr><tr><td>Wgt. {n}.5</td></tr><tr><td>FP Cost {n}</td></tr></table>'
    '<img src="/icon.png"><img src="/img{n}.jpg"><h2>Dialogue</h2><p><em>A spoken line number</em> <em>{n} here.</em></p><h2>Description</h2><p>A description of forty characters or more, number {n}.</p>'
    '<ul><li>Drop {n}<ul><li>Inner</li></ul></li></ul><a href="/Link{n}">l</a><a href="/Link{n}#x">l</a></div>'
)


def pages(spark: SparkSession, sf: str, column: str) -> DataFrame:
    """The url and a column of a page for each row of ``part``; rows are dealt out before their pages are made."""
    html = F.lit(PAGE)
    for mark, value in (("{name}", F.col("p_name")), ("{type}", F.col("p_type")), ("{n}", F.col("p_size").cast("string"))):
        html = F.replace(html, F.lit(mark), value)
    rows = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
    raw = rows.select(F.concat(F.lit(f"{BASE}/p"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))
    return parsed(raw, BASE, HOST, columns=("url", column))


_URL = "SELECT 'https://w.example/p' || p_partkey AS url, "


@register("h6_links", _URL + "['https://w.example/Link' || p_size] AS internal_links FROM part")
def h6(spark, sf):
    return pages(spark, sf, "internal_links")


@register("h7_breadcrumb", _URL + "['Equipment', 'Weapons'] AS breadcrumb FROM part")
def h7(spark, sf):
    return pages(spark, sf, "breadcrumb")


@register("h10_noise", _URL + "false AS has_noise FROM part")
def h10(spark, sf):
    return pages(spark, sf, "body_text").select("url", (F.contains("body_text", F.lit("bad")) | F.contains("body_text", F.lit("Equipment"))).alias("has_noise"))


@register("h13_own_text", _URL + "['Drop ' || p_size, 'Inner'] AS items FROM part")
def h13(spark, sf):
    return pages(spark, sf, "body_text").select("url", F.filter(F.split("body_text", "\n"), lambda x: x.rlike("^(Drop|Inner)")).alias("items"))


@register("h14_image", _URL + "'https://w.example/img' || p_size || '.jpg' AS image_url FROM part")
def h14(spark, sf):
    return pages(spark, sf, "image_url")


@register("h15_infobox", _URL + "p_type AS kind FROM part")
def h15(spark, sf):
    return pages(spark, sf, "infobox").select("url", F.col("infobox")["Kind"].alias("kind"))


@register("h17_stats", _URL + "'C' AS str_grade, p_size + 0.5::DOUBLE AS weight, p_size AS fp_cost, 1 AS n_scaling FROM part")
def h17(spark, sf):
    s = F.col("stats")
    return pages(spark, sf, "stats").select("url", s["scaling"]["str"].alias("str_grade"), s["weight"].alias("weight"), s["fp_cost"].alias("fp_cost"), F.size(s["scaling"]).alias("n_scaling"))


@register("h18_dialogue", _URL + "['A spoken line number ' || p_size || ' here.'] AS dialogue FROM part")
def h18(spark, sf):
    return pages(spark, sf, "dialogue")


@register("h19_descriptions", _URL + "['A description of forty characters or more, number ' || p_size || '.'] AS item_descriptions FROM part")
def h19(spark, sf):
    return pages(spark, sf, "item_descriptions")


@register("h20_body", _URL + "['## Dialogue', '## Description'] AS headings FROM part")
def h20(spark, sf):
    return pages(spark, sf, "body_text").select("url", F.filter(F.split("body_text", "\n"), lambda x: F.startswith(x, F.lit("## "))).alias("headings"))


def _folder(spark: SparkSession) -> str:
    """A folder of the shared scratch space, removed when the session ends."""
    return scratch_path(spark)


@register("s3_lenient_lines", "SELECT 'u' || doc_id AS url, lang AS category FROM documents WHERE doc_id % 5 <> 0")
def s3(spark, sf):
    path, line = _folder(spark), F.to_json(F.struct(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("category")))
    table(spark, sf, "documents").select(F.when(F.col("doc_id") % 5 == 0, F.lit("{broken")).otherwise(line).alias("value")).write.text(path)
    return files.read_lines(spark, path, files.MANIFEST)


@register("s4_strict_lines", "SELECT 'u' || doc_id AS url, lang AS category FROM documents")
def s4(spark, sf):
    path = _folder(spark)
    files.write_lines(table(spark, sf, "documents").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("category")), path)
    return files.read_lines(spark, path, files.MANIFEST, strict=True)


@register("s5_write_lines", "SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0")
def s5(spark, sf):
    path, rows = _folder(spark), table(spark, sf, "documents").select("doc_id", "source")
    files.write_lines(rows, path)
    files.write_lines(rows.filter("doc_id % 2 = 0"), path)
    return files.read_lines(spark, path, "doc_id long, source string", strict=True)


@register("s6_append_lines", "SELECT doc_id, source FROM documents")
def s6(spark, sf):
    path, rows = _folder(spark), table(spark, sf, "documents").select("doc_id", "source")
    for rest in (0, 1):
        files.write_lines(rows.filter(F.col("doc_id") % 2 == rest), path, append=True)
    return files.read_lines(spark, path, "doc_id long, source string", strict=True)


@register("s7_text_list", "SELECT DISTINCT source AS value FROM documents")
def s7(spark, sf):
    path = _folder(spark)
    files.write_list(table(spark, sf, "documents").select(F.col("source").alias("value")), path)
    return files.read_list(spark, path)


def _collection(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.md5(F.col("vec_id").cast("string").cast("binary")).alias("chunk_id"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("category"))


@register("s9_recreate", "SELECT vec_id AS point_id FROM embeddings WHERE vec_id % 2 = 0")
def s9(spark, sf):
    path = _folder(spark)
    collections.create(_collection(spark, sf), path)
    collections.create(_collection(spark, sf).filter("point_id % 2 = 0"), path)
    return collections.load(spark, path).select("point_id")


@register("s10_layout", "SELECT vec_id AS point_id FROM embeddings WHERE label % 3 = 1")
def s10(spark, sf):
    """The category is a partition, so the filter prunes files."""
    path = _folder(spark)
    collections.create(_collection(spark, sf), path)
    return collections.load(spark, path).filter("category = 'c1'").select("point_id")


@register("s12_settled", "SELECT count(*) AS n FROM embeddings")
def s12(spark, sf):
    rows = _collection(spark, sf)
    sent = collections.aligned(rows, table(spark, sf, "embeddings"))
    return collections.settled(lambda: _collection(spark, sf), sent, wait=0.1, most=5).agg(F.count("*").alias("n"))


@register("s13_versions", "SELECT vec_id AS point_id, CASE WHEN vec_id < 100 THEN 'new' ELSE md5(CAST(vec_id AS VARCHAR)) END AS chunk_id FROM embeddings")
def s13(spark, sf):
    path, rows = _folder(spark), _collection(spark, sf)
    collections.create(rows, f"{path}/v=1")
    batch = rows.filter("point_id < 100").withColumns({"chunk_id": F.lit("new"), "batch_at": F.lit(1)})
    return collections.next_version(spark, path, 1, batch).select("point_id", "chunk_id")


@register("s15_gazetteer", "SELECT lang AS name, count(*) AS freq FROM documents GROUP BY lang")
def s15(spark, sf):
    path = _folder(spark)
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    made = counts.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("entities"), F.count("*").alias("count"))).alias("value"))
    made.coalesce(1).write.text(path)
    return collections.gazetteer(spark, path)


@register("g2_partial_writes", "SELECT doc_id FROM documents")
def g2(spark, sf):
    """A batch that is written again after a failure replaces itself."""
    from corpusweave.streaming.incremental import batch_folder

    path, rows = _folder(spark), table(spark, sf, "documents").select("doc_id")
    write = batch_folder(path)
    write(rows.filter("doc_id % 2 = 0 and doc_id < 50"), 0)
    write(rows.filter("doc_id % 2 = 0"), 0)
    write(rows.filter("doc_id % 2 = 1"), 1)
    return spark.read.parquet(path).select("doc_id")


@register("f11_facet_whitelist", """
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN '{' || CASE WHEN p_size % 3 = 0 THEN '"scaling_dex_min": "C", ' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '"sort": "weight_desc", ' ELSE '' END || '"weight_max": ' || p_size || '}' END AS facets FROM part""")
def f11(spark, sf):
    from corpusweave.plans.batch import known_facets

    size = F.col("p_size")
    some = F.struct(
        F.when(size % 7 != 0, size).alias("weight_max"), F.col("p_type").alias("enumerate_group"), F.when((size % 7 != 0) & (size % 3 == 0), "C").alias("scaling_dex_min"),
        F.lit("A").alias("scaling_luck_min"), F.when((size % 7 != 0) & (size % 2 == 0), "weight_desc").otherwise("by name").alias("sort"),
    )
    return table(spark, sf, "part").select("p_partkey", known_facets(F.to_json(some)).alias("facets"))


def _plans(spark, sf, entities, query):
    """A plan a row of ``part``, its fields from the row's size."""
    from corpusweave.plans.batch import planned

    size = F.col("p_size")
    intent = F.element_at(F.array(F.lit("summary"), F.lit("lore"), F.lit(None), F.lit("quest")), (size % 4 + 1).cast("int"))
    kind = F.when(size % 5 == 0, "dialogue").otherwise("item_desc")
    made = planned(F.lit("list them"), size % 2 == 0, entities, intent, F.when(size % 3 == 0, "boss"), kind, query)
    return table(spark, sf, "part").select("p_partkey", made.alias("plan")).select("p_partkey", "plan.*")


@register("f18_origin", """
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN ['X' || p_size, 'Y' || p_size] ELSE ['Y' || p_size] END AS entities FROM part""")
def f18(spark, sf):
    k = F.col("p_size").cast("string")
    query = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("how to reach Y"), k, F.lit(" from the X"), k)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("From X"), k, F.lit(" to the south"))).otherwise(F.concat(F.lit("where is Y"), k))
    return _plans(spark, sf, F.array(F.concat(F.lit("X"), k), F.concat(F.lit("Y"), k)), query).select("p_partkey", "entities")


@register("g6_rules", """
SELECT p_partkey, p_size % 2 = 0 OR p_size % 7 = 0 OR p_size % 4 = 0 AS retrieves, CASE WHEN p_size % 4 IN (0, 3) THEN 14 ELSE 8 END AS k,
CASE WHEN p_size % 3 = 0 AND p_size % 7 <> 0 AND p_size % 4 IN (1, 2) THEN 'boss' END AS category, CASE WHEN p_size % 5 = 0 THEN 'dialogue' END AS chunk_type FROM part""")
def g6(spark, sf):
    entities = F.when(F.col("p_size") % 7 == 0, F.array(F.lit("E"))).otherwise(F.array().cast("array<string>"))
    return _plans(spark, sf, entities, F.lit(None).cast("string")).select("p_partkey", F.col("needs_retrieval").alias("retrieves"), "k", "category", "chunk_type")


@register("x27_settings", "SELECT event_id, event_type IN ('view', 'click') AS flag, event_type AS provider, 'm:' || user_id AS model FROM events")
def x27(spark, sf):
    text = F.when(F.col("event_type").isin("view", "click"), F.lit(" Yes")).otherwise(F.lit("off"))
    provider, model = config.tier_columns(F.concat(F.upper("event_type"), F.lit(":m:"), F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", config.bool_column(text).alias("flag"), provider.alias("provider"), model.alias("model"))


@register("g7_tiers", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'first/x' WHEN 1 THEN 'second/m:1' WHEN 2 THEN 'third/None' END AS answer FROM part""")
def g7(spark, sf):
    """Answers and empty answers, errors that pass on and one that doesn't, by tier."""
    from corpusweave.plans.batch import tier_answer

    ways = ("ok", "ok", "ok"), ("retry", "ok", "ok"), ("empty", "retry", "ok"), ("retry", "denied", "ok"), ("retry", "retry", "retry")
    outcomes = F.element_at(F.array(*(F.array(*map(F.lit, w)) for w in ways)), (F.col("p_size") % 5 + 1).cast("int"))
    specs = F.array(F.lit("first:x"), F.lit(" Second : m:1"), F.lit("third"))
    return table(spark, sf, "part").select("p_partkey", tier_answer(specs, outcomes).alias("answer"))
