"""Queries of filters, ranked retrieval, rosters and assembly, over a stand-in chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusweave.catalog import table
from corpusweave.operators import assemble, retrieve
from corpusweave.operators.vectors import norm, sanity, upsert
from corpusweave.plans.retrieval import RetrievalPlan, conjunction, facet_predicates
from corpusweave.registry import register

CHUNKS = """
SELECT vec_id AS point_id, embedding AS vector, 'page' || label AS url,
'Title ' || (vec_id % 40) || CASE WHEN vec_id % 5 = 0 THEN ' +' || (vec_id % 3 + 1) WHEN vec_id % 7 = 0 THEN ' Set' ELSE '' END AS title,
CASE vec_id % 4 WHEN 0 THEN 'Overview' WHEN 1 THEN 'Drops' WHEN 2 THEN 'Dialogue' ELSE 'Stats' END AS section_heading,
CASE WHEN vec_id % 2 = 0 THEN ['Equipment', 'Weapons'] ELSE ['World', 'Bosses'] END AS breadcrumb,
CASE vec_id % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'dialogue' ELSE 'item_desc' END AS chunk_type,
CASE WHEN label < 5 THEN 'item' ELSE 'boss' END AS category, 'page' AS doc_type, 'raw ' || (vec_id % 450) AS raw_text,
['Title ' || (vec_id % 40), 'E' || label] AS entities, 'Title ' || (vec_id % 40) AS subject, vec_id % 10 = 0 AS dlc,
CAST(vec_id % 50 AS DOUBLE) AS weight, CAST(vec_id % 30 AS INT) AS fp_cost, substr('SABCDE', CAST(vec_id % 6 + 1 AS INT), 1) AS scaling_dex,
CASE WHEN vec_id % 3 = 0 THEN ['Fire', 'Holy'] ELSE ['Slash'] END AS weak_to, CASE WHEN vec_id % 6 = 0 THEN '' ELSE 'img' || (label % 6) END AS image_url
FROM embeddings"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    v, k = F.col("vec_id"), lambda n: F.col("vec_id") % n
    number = F.concat(F.lit("Title "), k(40).cast("string"))
    suffix = F.when(k(5) == 0, F.concat(F.lit(" +"), (k(3) + 1).cast("string"))).when(k(7) == 0, F.lit(" Set")).otherwise(F.lit(""))
    words = lambda *w: F.array(*map(F.lit, w))
    return table(spark, sf, "embeddings").select(
        v.alias("point_id"), F.col("embedding").alias("vector"), F.concat(F.lit("page"), F.col("label").cast("string")).alias("url"), F.concat(number, suffix).alias("title"),
        F.element_at(words("Overview", "Drops", "Dialogue", "Stats"), (k(4) + 1).cast("int")).alias("section_heading"),
        F.when(k(2) == 0, words("Equipment", "Weapons")).otherwise(words("World", "Bosses")).alias("breadcrumb"),
        F.element_at(words("body", "dialogue", "item_desc"), (k(3) + 1).cast("int")).alias("chunk_type"),
        F.when(F.col("label") < 5, "item").otherwise("boss").alias("category"), F.lit("page").alias("doc_type"), F.concat(F.lit("raw "), k(450).cast("string")).alias("raw_text"),
        F.array(number, F.concat(F.lit("E"), F.col("label").cast("string"))).alias("entities"), number.alias("subject"), (k(10) == 0).alias("dlc"),
        k(50).cast("double").alias("weight"), k(30).cast("int").alias("fp_cost"), F.substring(F.lit("SABCDE"), (k(6) + 1).cast("int"), F.lit(1)).alias("scaling_dex"),
        F.when(k(3) == 0, words("Fire", "Holy")).otherwise(words("Slash")).alias("weak_to"), F.when(k(6) == 0, F.lit("")).otherwise(F.concat(F.lit("img"), (F.col("label") % 6).cast("string"))).alias("image_url"),
    )


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


_IDS = "SELECT point_id FROM (" + CHUNKS + ") c WHERE "


def _ids(spark, sf, facets):
    return chunks(spark, sf).filter(conjunction(facet_predicates(facets))).select("point_id")


@register("f1_equality", _IDS + "category = 'item' AND chunk_type = 'body' AND doc_type = 'page'")
def f1(spark, sf):
    plan = RetrievalPlan("q", category="item", chunk_type="body")
    return chunks(spark, sf).filter(conjunction(retrieve.predicates(plan, "page"))).select("point_id")


@register("f2_match_any", _IDS + "list_has_any(weak_to, ['Holy', 'Ice']) AND list_has_any(entities, ['E1', 'E2', 'Title 3'])")
def f2(spark, sf):
    plan = RetrievalPlan("q", entities=("E1", "E2", "Title 3"), facets={"weak_to": ["Holy", "Ice"]})
    return chunks(spark, sf).filter(conjunction(retrieve.predicates(plan))).select("point_id")


@register("f3_array_contains", _IDS + "list_contains(breadcrumb, 'Weapons')")
def f3(spark, sf):
    return chunks(spark, sf).filter(F.array_contains("breadcrumb", "Weapons")).select("point_id")


@register("f4_range", _IDS + "weight >= 10 AND weight <= 30 AND fp_cost <= 12")
def f4(spark, sf):
    return _ids(spark, sf, {"weight_min": 10, "weight_max": "30", "fp_cost_max": 12, "fp_cost_min": "many"})


@register("f5_grade_threshold", _IDS + "scaling_dex IN ('S', 'A', 'B', 'C') AND list_contains(breadcrumb, 'Weapons')")
def f5(spark, sf):
    return _ids(spark, sf, {"scaling_dex_min": "c"})


@register("f6_grade_scope", _IDS + "list_contains(breadcrumb, 'Weapons')")
def f6(spark, sf):
    return _ids(spark, sf, {"scaling_dex_max": "Z"})


@register("f7_conjunction", _IDS + "category = 'boss' AND dlc AND list_has_any(weak_to, ['Slash'])")
def f7(spark, sf):
    plan = RetrievalPlan("q", category="boss", facets={"dlc": True, "weak_to": ["Slash", None, ""]})
    return chunks(spark, sf).filter(conjunction(retrieve.predicates(plan))).select("point_id")


@register("f7_unbounded_roster", "SELECT 'x' AS title WHERE false")
def f7b(spark, sf):
    return retrieve.enumerate_titles(chunks(spark, sf), doc_type=None)


@register("f8_empty_values", _IDS + "dlc")
def f8(spark, sf):
    return _ids(spark, sf, {"weak_to": [], "weapon_type": "", "strong_vs": None, "dlc": True})


@register("f9_projection", "SELECT title, weight FROM (" + CHUNKS + ") c WHERE weight > 40")
def f9(spark, sf):
    return chunks(spark, sf).filter("weight > 40").select("title", "weight")


@register("f13_answer_gate", "SELECT DISTINCT url FROM (" + CHUNKS + ") c WHERE lower(title) = 'title 3' OR contains(trim(regexp_replace(lower('see Title 7 or title-12!'), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')))")
def f13(spark, sf):
    rows = chunks(spark, sf).withColumn("rank", F.col("point_id"))
    return assemble.sources(rows, ("Title 3",), "see Title 7 or title-12!").select("url")


@register("f14_visual_pages", "SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(p_name), 'stats|comparison|calculating|damage|poise|skills|level|hp|upgrades|controls|builds|route|bosses|items|locations|weapons|npc|armor|shields|talismans|spells|endings|axes|hammers|flails|spears|whips|fists|bows|torches|reapers|katanas|daggers|greatswords|merchants|creatures|walkthrough|sorceries|incantations|halberds|twinblades|crossbows|cookbooks|hemorrhage|ballistae')")
def f14(spark, sf):
    return table(spark, sf, "part").filter(assemble.is_visual(F.col("p_name"))).select("p_partkey")


@register("f15_sets", "SELECT DISTINCT title FROM (" + CHUNKS + ") c WHERE list_contains(breadcrumb, 'Weapons') AND title LIKE '% Set'")
def f15(spark, sf):
    return retrieve.enumerate_titles(chunks(spark, sf), "Weapons Sets")


@register("a2_enumerate_titles", r"SELECT DISTINCT trim(regexp_replace(title, '\s*\+\d+$', '')) AS title FROM (" + CHUNKS + ") c WHERE list_contains(breadcrumb, 'Bosses') AND category = 'boss'")
def a2(spark, sf):
    return retrieve.enumerate_titles(chunks(spark, sf), "Bosses", "boss")


@register("a3_best_by_title", "SELECT title, max(weight) AS heaviest, min(weight) AS lightest FROM (" + CHUNKS + ") c GROUP BY title")
def a3(spark, sf):
    return chunks(spark, sf).groupBy("title").agg(F.max("weight").alias("heaviest"), F.min("weight").alias("lightest"))


_TOP = "SELECT title, value FROM (SELECT title, {f}(weight) AS value, min(point_id) AS first FROM (" + CHUNKS + ") c WHERE list_contains(breadcrumb, 'Weapons') GROUP BY title) ORDER BY value {d}, first, title LIMIT 15"


@register("t4_top_by_facet", _TOP.format(f="max", d="DESC"))
def t4(spark, sf):
    return retrieve.top_by_facet(chunks(spark, sf), "weight", "Weapons")


@register("t4_bottom_by_facet", _TOP.format(f="min", d="ASC"))
def t4b(spark, sf):
    return retrieve.top_by_facet(chunks(spark, sf), "weight", "Weapons", desc=False)


@register("a10_roster", "SELECT count(*) AS n_titles, list(title ORDER BY title)[1:15] AS shown FROM (SELECT DISTINCT trim(regexp_replace(title, '\\s*\\+\\d+$', '')) AS title FROM (" + CHUNKS + ") c WHERE list_contains(breadcrumb, 'Bosses'))")
def a10(spark, sf):
    titles = retrieve.enumerate_titles(chunks(spark, sf), "Bosses")
    return titles.agg(F.count("title").alias("n_titles"), F.slice(F.sort_array(F.collect_list("title")), 1, retrieve.ROSTER_ROWS).alias("shown"))


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_SCORE = f"list_inner_product(CAST(vector AS DOUBLE[]), CAST({_Q} AS DOUBLE[]))"


@register("x21_cosine", f"SELECT point_id, round({_SCORE}, 6) AS score FROM ({CHUNKS}) c")
def x21(spark, sf):
    v = retrieve.vector_literal(query_vector(spark, sf))
    return chunks(spark, sf).select("point_id", F.round(retrieve.dot(F.col("vector"), v), 6).alias("score"))


@register("j7_nearest", f"SELECT point_id, round(s, 6) AS score FROM (SELECT point_id, {_SCORE} AS s FROM ({CHUNKS}) c WHERE category = 'item') ORDER BY s DESC, point_id LIMIT 40")
def j7(spark, sf):
    v = retrieve.vector_literal(query_vector(spark, sf))
    found = chunks(spark, sf).filter("category = 'item'").withColumn("s", retrieve.dot(F.col("vector"), v))
    return found.orderBy(F.desc("s"), "point_id").limit(40).select("point_id", F.round("s", 6).alias("score"))


_T1 = """
WITH c AS (SELECT *, {score} AS score FROM ({chunks}) c WHERE {where}),
f AS (SELECT * FROM c ORDER BY score DESC, point_id LIMIT {fetch}),
b AS (SELECT *, {boost} + CASE WHEN row_number() OVER (PARTITION BY url ORDER BY score DESC, point_id) > 2 THEN -0.04 ELSE 0 END AS boost FROM f),
k AS (SELECT *, score + boost AS final_score FROM b),
u AS (SELECT *, row_number() OVER (PARTITION BY raw_text ORDER BY final_score DESC, score DESC, point_id) AS rn FROM k)
SELECT point_id, round(score, 6) AS score, round(CAST(boost AS DOUBLE), 6) AS boost, round(CAST(final_score AS DOUBLE), 6) AS final_score FROM u WHERE rn = 1 ORDER BY u.final_score DESC, u.score DESC, point_id LIMIT {k}"""
_DROPS = "CASE WHEN contains(lower(section_heading), 'drops') OR contains(lower(section_heading), 'overview') THEN 0.05 ELSE 0 END + CASE WHEN contains(lower(array_to_string(breadcrumb, ' / ')), 'bosses') OR contains(lower(array_to_string(breadcrumb, ' / ')), 'items') THEN 0.03 ELSE 0 END"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("point_id", *(F.round(c, 6).alias(c) for c in ("score", "boost", "final_score")))


@register("t1_retrieve", _T1.format(score=_SCORE, chunks=CHUNKS, where="category = 'item'", fetch=40, boost=_DROPS, k=8))
def t1(spark, sf):
    return _rounded(retrieve.retrieve(chunks(spark, sf), query_vector(spark, sf), RetrievalPlan("q", intent="drops", category="item")))


@register("t2_overfetch", f"SELECT point_id FROM (SELECT point_id, {_SCORE} AS s FROM ({CHUNKS}) c) ORDER BY s DESC, point_id LIMIT 8")
def t2(spark, sf):
    return retrieve.retrieve(chunks(spark, sf), query_vector(spark, sf), RetrievalPlan("q"), diversity=False).select("point_id")


@register("t3_subject_resort", _T1.format(score=_SCORE, chunks=CHUNKS, where="list_has_any(entities, ['Title 1', 'E2', 'E3'])", fetch=40, boost="CASE WHEN lower(subject) IN ('title 1', 'e2', 'e3') THEN 0.06 ELSE 0 END", k=14))
def t3(spark, sf):
    plan = RetrievalPlan("q", entities=("Title 1", "E2", "E3"), k=14)
    return _rounded(retrieve.retrieve(chunks(spark, sf), query_vector(spark, sf), plan))


@register("x22_structural_boost", f"SELECT point_id, round(CAST({_DROPS} AS DOUBLE), 6) AS boost FROM ({CHUNKS}) c")
def x22(spark, sf):
    return chunks(spark, sf).select("point_id", F.round(retrieve.structural_boost("drops", F.col("section_heading"), F.col("breadcrumb"), F.col("chunk_type")), 6).alias("boost"))


@register("w1_diversity", f"SELECT point_id, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY point_id) > 2 THEN -0.04::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM ({CHUNKS}) c")
def w1(spark, sf):
    return chunks(spark, sf).select("point_id", retrieve.diversity_penalty("url", [F.asc("point_id")]).alias("penalty"))


@register("w2_keep_first", f"SELECT min(point_id) AS point_id, raw_text FROM ({CHUNKS}) c GROUP BY raw_text")
def w2(spark, sf):
    return retrieve.keep_first(chunks(spark, sf), "raw_text", [F.asc("point_id")]).select("point_id", "raw_text")


@register("w4_sources", f"SELECT arg_min(title, point_id) AS title, url, arg_min(section_heading, point_id) AS section, arg_min(category, point_id) AS category FROM ({CHUNKS}) c GROUP BY url")
def w4(spark, sf):
    return assemble.sources(chunks(spark, sf).withColumn("rank", F.col("point_id"))).select("title", "url", "section", "category")


@register("a4_pages", f"SELECT url, count(*) AS n_chunks, max(weight) AS best, arg_min(title, point_id) AS title FROM ({CHUNKS}) c GROUP BY url")
def a4(spark, sf):
    return chunks(spark, sf).groupBy("url").agg(F.count("*").alias("n_chunks"), F.max("weight").alias("best"), F.min_by("title", "point_id").alias("title"))


@register("t7_images", f"""
WITH p AS (SELECT url, arg_min(image_url, point_id) AS image_url, arg_min(title, point_id) AS title, min(point_id) AS first, count(*) AS n, max(weight) AS best, arg_min(lower(title) = 'title 2', point_id) AS own FROM ({CHUNKS}) c WHERE image_url <> '' GROUP BY url),
q AS (SELECT *, row_number() OVER (PARTITION BY image_url ORDER BY own DESC, best DESC, n DESC, first) AS rn FROM p WHERE n >= 2 OR best >= 0.74)
SELECT image_url, title, url FROM q WHERE rn = 1 ORDER BY own DESC, best DESC, n DESC, first LIMIT 4""")
def t7(spark, sf):
    rows = chunks(spark, sf).withColumns({"rank": F.col("point_id"), "boost": F.lit(0.0), "score": F.col("weight"), "final_score": F.col("weight")})
    return assemble.images(rows, ("Title 2",))


@register("w6_context", f"""
WITH RECURSIVE b AS (SELECT row_number() OVER (ORDER BY point_id) AS i, '=== ' || title || CASE WHEN section_heading = 'Overview' THEN '' ELSE ' · ' || section_heading END || ' ===' || chr(10) || raw_text AS block FROM ({CHUNKS}) c),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, ''::VARCHAR AS context UNION ALL SELECT b.i, CASE WHEN used + length(block) <= 12000 THEN used + length(block) ELSE used END, CASE WHEN used + length(block) > 12000 THEN context WHEN context = '' THEN block ELSE context || chr(10) || chr(10) || block END FROM r JOIN b ON b.i = r.i + 1)
SELECT context FROM r ORDER BY i DESC LIMIT 1""")
def w6(spark, sf):
    return assemble.context(chunks(spark, sf).withColumn("rank", F.col("point_id")))


@register("a12_answer_stats", f"SELECT count(*) AS n_chunks, count(DISTINCT url) AS n_pages, list(title ORDER BY point_id)[1:3] AS top_titles FROM ({CHUNKS}) c")
def a12(spark, sf):
    rows = chunks(spark, sf).withColumns({"rank": F.col("point_id"), "final_score": F.col("weight")})
    return assemble.answer_stats(rows).select("n_chunks", "n_pages", "top_titles")


@register("a6_vector_sanity", """
WITH v AS (SELECT vec_id, embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)
SELECT count(*) AS n_rows, max(len(embedding)) AS dim, 0 AS nan_rows, 0 AS inf_rows, count(*) FILTER (n < 1e-6) AS zero_rows, count(DISTINCT vec_id) AS n_ids, round(min(n), 4) AS min_norm, round(max(n), 4) AS max_norm,
count(*) - count(DISTINCT vec_id) AS collisions, true AS passed, false AS norm_warning FROM v""")
def a6(spark, sf):
    return sanity(table(spark, sf, "embeddings"), "vec_id", "embedding")


@register("s8_vectors", "SELECT vec_id, len(embedding) AS dim, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm FROM embeddings")
def s8(spark, sf):
    """Vectors through ``.npy`` files and back, row by row in step with their ids."""
    from corpusweave.catalog import scratch
    from corpusweave.sources.collections import aligned, read_npy, write_npy

    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector")).repartition(1)
    with scratch(spark) as path:
        write_npy(rows, path, "vec_id")
        back = read_npy(spark, path)
        aligned(rows, back)
        place = F.row_number().over(Window.orderBy("vec_id"))
        ids = rows.select("vec_id", place.alias("place"))
        found = back.select("vector", F.row_number().over(Window.orderBy("file", "at")).alias("place"))
        return ids.join(found, "place").select("vec_id", F.size("vector").alias("dim"), F.round(norm(F.col("vector")), 5).alias("norm")).checkpoint()


@register("s11_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 100 + label ELSE label END AS label FROM embeddings")
def s11(spark, sf):
    base = table(spark, sf, "embeddings").select("vec_id", "label")
    first = base.filter("vec_id % 3 = 0").withColumns({"label": F.col("label") + 50, "batch_at": F.lit(1)})
    batch = first.unionByName(first.withColumns({"label": F.col("label") + 50, "batch_at": F.lit(2)}))
    return upsert(base, batch, "vec_id", "batch_at")


@register("s14_scroll", f"SELECT title FROM ({CHUNKS}) c WHERE list_contains(breadcrumb, 'Weapons') AND category = 'item'")
def s14(spark, sf):
    from corpusweave.sources.collections import scroll

    return scroll(chunks(spark, sf), [F.array_contains("breadcrumb", "Weapons"), F.col("category") == "item"], "title")


@register("f10_payload", f"SELECT point_id, title, dlc, weight FROM ({CHUNKS}) c")
def f10(spark, sf):
    from corpusweave.sources.collections import payload

    nested = chunks(spark, sf).select("point_id", "title", F.lit(False).alias("dlc"), F.struct("dlc", "weight").alias("facets"))
    return payload(nested)


@register("g5_fallback", f"SELECT point_id FROM (SELECT point_id, {_SCORE} AS s, url, raw_text FROM ({CHUNKS}) c) ORDER BY s DESC, point_id LIMIT 1")
def g5(spark, sf):
    return retrieve.run_plan(chunks(spark, sf), query_vector(spark, sf), RetrievalPlan("q", entities=("nobody",), k=1))[0].select("point_id")


@register("t5_broad_k", "SELECT count(*) AS n FROM (SELECT raw_text FROM embeddings, range(1) t, LATERAL (SELECT 'raw ' || (vec_id % 450) AS raw_text) LIMIT 14)")
def t5(spark, sf):
    return retrieve.run_plan(chunks(spark, sf), query_vector(spark, sf), RetrievalPlan("q", intent="summary"))[0].agg(F.count("*").alias("n"))
