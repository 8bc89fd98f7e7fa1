"""Queries of the text, URL and identifier functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.catalog import table
from corpusweave.functions import text as X
from corpusweave.registry import register

BASE = "https://pages.example.org"
DOC = "SELECT doc_id, lang, source, n_chars, text FROM documents"


@register("x1_chunk_id", "SELECT doc_id, substr(md5(concat_ws('|', source, 'body', CAST(doc_id AS VARCHAR))), 1, 16) AS chunk_id FROM documents")
def x1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.chunk_id(F.col("source"), F.lit("body"), F.col("doc_id")).alias("chunk_id"))


@register("x2_point_id", "SELECT doc_id, CAST(('0x' || substr(md5(concat_ws('|', source, 'body', CAST(doc_id AS VARCHAR))), 1, 16))::UBIGINT AS VARCHAR) AS point_id FROM documents")
def x2(spark, sf):
    return x1(spark, sf).select("doc_id", X.point_id(F.col("chunk_id")).cast("string").alias("point_id"))


@register("x3_content_hash", "SELECT doc_id, md5(source || chr(10) || text) AS content_hash FROM documents")
def x3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@register("x4_slug_name", "SELECT page_id, trim(url_decode(replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '+', ' '))) AS name FROM pages")
def x4(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slug_name(F.col("url")).alias("name"))


@register("x5_clean_heading", r"""
WITH h AS (SELECT doc_id, source AS title, CASE doc_id % 5 WHEN 0 THEN 'Wiki ' || source || ' - Notes' WHEN 1 THEN source || ': Drops' WHEN 2 THEN 'Wiki Lore' WHEN 3 THEN source ELSE ' Combat ' END AS h FROM documents),
c AS (SELECT doc_id, CASE WHEN starts_with(lower(trim(h)), lower('Wiki ' || title)) THEN trim(substr(trim(h), length('Wiki ' || title) + 1), ' -–—:·|')
WHEN starts_with(lower(trim(h)), lower(title)) THEN trim(substr(trim(h), length(title) + 1), ' -–—:·|')
WHEN starts_with(lower(trim(h)), 'wiki') THEN trim(substr(trim(h), 5), ' -–—:·|') ELSE trim(h) END AS heading FROM h)
SELECT doc_id, CASE WHEN heading = '' THEN 'Overview' ELSE heading END AS heading FROM c""")
def x5(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 5
    h = F.when(k == 0, F.concat(F.lit("Wiki "), F.col("source"), F.lit(" - Notes"))).when(k == 1, F.concat(F.col("source"), F.lit(": Drops"))).when(k == 2, F.lit("Wiki Lore")).when(k == 3, F.col("source")).otherwise(F.lit(" Combat "))
    return d.select("doc_id", X.clean_heading(h, F.col("source"), "Wiki").alias("heading"))


@register("x6_context_prefix", """
SELECT doc_id, '[' || lang || ' / ' || source || ' / ' || 'Doc ' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '' ELSE ' · Section' END || ']' AS prefix FROM documents""")
def x6(spark, sf):
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    section = F.when(F.col("doc_id") % 3 == 0, F.lit("Overview")).when(F.col("doc_id") % 3 == 1, F.upper(title)).otherwise(F.lit("Section"))
    return table(spark, sf, "documents").select("doc_id", X.context_prefix(F.array("lang", "source"), title, section).alias("prefix"))


@register("x7_sections", r"""
SELECT doc_id, count(*) AS n_sections, sum(length(line)) AS n_chars FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents) WHERE line <> '' GROUP BY doc_id""")
def x7(spark, sf):
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n## Part\n"))
    found = table(spark, sf, "documents").select("doc_id", F.explode(X.sections(body)).alias("s"))
    return found.groupBy("doc_id").agg(F.count("s").alias("n_sections"), F.sum(F.length("s.content")).alias("n_chars"))


@register("x8_sentences", r"""
SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) GROUP BY doc_id""")
def x8(spark, sf):
    s = X.sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.array_max(F.transform(s, F.length)).cast("long").alias("longest"))


@register("x10_token_count", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents")
def x10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("n_tokens"))


@register("x10_word_pieces")
def x10_word_pieces(spark, sf):
    """Word pieces under the least vocabulary; a vocabulary file is the operator's parameter."""
    from corpusweave.functions import tokens

    return table(spark, sf, "documents").select("doc_id", tokens.counted(tokens.WordPieces(tokens.letter_vocabulary()))("text").alias("n_pieces"))


@register("x12_phonetic", r"""
SELECT p_partkey, soundex_key FROM (SELECT p_partkey, substr(lower(p_name), 1, 1) || regexp_replace(substr(lower(p_name), 2), '[aeiou]', '', 'g') AS k FROM part),
LATERAL (SELECT list_reduce(list_transform(range(1, length(k) + 1), lambda i: CASE WHEN i > 1 AND substr(k, i, 1) = substr(k, i - 1, 1) THEN '' ELSE substr(k, i, 1) END), lambda a, b: a || b) AS soundex_key)""")
def x12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.phonetic_skeleton(F.col("p_name")).alias("soundex_key"))


@register("x13_norm_text", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def x13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.norm_text(F.col("text")).alias("norm"))


@register("x14_norm_quotes", r"SELECT doc_id, trim(regexp_replace(translate(replace(lower(text), ',', ' '), '’‘', ''''''), '\s+', ' ', 'g')) AS norm FROM documents")
def x14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.norm_quotes(F.col("text")).alias("norm"))


@register("x15_norm_commas", r"SELECT conv_id, turn, trim(regexp_replace(replace(lower(text), ',', ' '), '\s+', ' ', 'g')) AS norm FROM conversations")
def x15(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.norm_commas(F.col("text")).alias("norm"))


@register("x16_grade", "SELECT p_partkey, CASE substr('SABCDEZ', CAST(p_size % 7 + 1 AS INT), 1) WHEN 'S' THEN 6 WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 WHEN 'E' THEN 1 END AS grade FROM part")
def x16(spark, sf):
    letter = F.substring(F.lit("SABCDEZ"), F.col("p_size") % 7 + 1, F.lit(1))
    return table(spark, sf, "part").select("p_partkey", X.grade(letter).alias("grade"))


@register("x17_weapon_type", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Glintstone Staffs' WHEN p_size % 3 = 1 THEN 'Ballistae' ELSE p_type END AS weapon_type FROM part")
def x17(spark, sf):
    leaf = F.when(F.col("p_size") % 3 == 0, F.lit(" Glinstone Staves")).when(F.col("p_size") % 3 == 1, F.lit("Ballistas")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", X.weapon_type(leaf).alias("weapon_type"))


@register("x23_title_truncate", "SELECT conv_id, turn, substr(text, 1, 80) AS title, substr(text, 1, 200) AS logged FROM conversations")
def x23(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.substring("text", 1, 80).alias("title"), F.substring("text", 1, 200).alias("logged"))


@register("x25_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def x25(spark, sf):
    noisy = F.concat(F.lit("answer: "), F.col("props"), F.lit(" done"))
    return table(spark, sf, "events").select("event_id", F.from_json(X.json_object(noisy), "k long")["k"].alias("k"))


@register("x26_follow_up", "SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS question FROM conversations")
def x26(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.without_follow_up(F.concat("text", F.lit(" (Follow-up question) "))).alias("question"))


@register("x28_context_block", "SELECT doc_id, '=== ' || source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' · ' || lang END || ' ===' || chr(10) || text AS block FROM documents")
def x28(spark, sf):
    section = F.when(F.col("doc_id") % 2 == 0, F.lit("Overview")).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", X.context_block(F.col("source"), section, F.col("text")).alias("block"))


@register("h4_absolute_url", r"""
WITH h AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://[^/]*', '') WHEN 2 THEN regexp_replace(url, '^https?:', '') ELSE 'mailto:x' END AS href FROM pages)
SELECT page_id, nullif(regexp_replace(split_part(CASE WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://pages.example.org' || href WHEN starts_with(href, 'http') THEN href END, '#', 1), '/+$', ''), '') AS url FROM h""")
def h4(spark, sf):
    k = F.col("page_id") % 4
    href = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^https?://[^/]*", "")).when(k == 2, F.regexp_replace("url", "^https?:", "")).otherwise(F.lit("mailto:x"))
    return table(spark, sf, "pages").select("page_id", X.absolute(href, BASE).alias("url"))


@register("h5_content_url", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT page_id, host = (SELECT min(host) FROM u) AND path <> '' AND NOT starts_with(path, '/file/') AND NOT regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|webp|svg|ico|pdf)$')
AND NOT contains(url, 'action=') AND NOT contains(url, '/Shop') AND NOT contains(url, '/forums') AND NOT contains(url, '/news') AND NOT contains(url, '/blog') AND NOT contains(url, '?') AND NOT contains(url, '#') AS is_content FROM u""")
def h5(spark, sf):
    pages = table(spark, sf, "pages")
    host = pages.agg(F.min(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))).first()[0]
    return pages.select("page_id", X.content_url(F.col("url"), host).alias("is_content"))


@register("h9_category", """
WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Bosses of ' || source WHEN 1 THEN 'key items' WHEN 2 THEN 'Side Quests' WHEN 3 THEN 'Lore' ELSE source END AS leaf, lang FROM documents)
SELECT doc_id, CASE WHEN leaf LIKE 'Bosses%' THEN 'boss' WHEN leaf = 'key items' THEN 'item' WHEN leaf = 'Side Quests' THEN 'quest' WHEN leaf = 'Lore' THEN 'lore' ELSE 'location' END AS category FROM c""")
def h9(spark, sf):
    k = F.col("doc_id") % 5
    leaf = F.when(k == 0, F.concat(F.lit("Bosses of "), F.col("source"))).when(k == 1, F.lit("key items")).when(k == 2, F.lit("Side Quests")).when(k == 3, F.lit("Lore")).otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", X.category(F.array(F.lit("Legacy Dungeons"), leaf), F.lit("none")).alias("category"))


@register("h11_nav_list", "SELECT doc_id, doc_id % 3 = 0 AS is_nav FROM documents")
def h11(spark, sf):
    k = F.col("doc_id") % 3
    x = F.when(k == 0, F.lit("Axes ♦ Bows ♦ Claws")).when(k == 1, F.lit("axes ♦ bows ♦ Claws")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.is_nav_list(x).alias("is_nav"))


@register("h12_category_nav", "SELECT doc_id, doc_id % 2 = 0 AS is_nav FROM documents")
def h12(spark, sf):
    items = F.array(F.lit("Axes"), F.lit("Bows "), F.when(F.col("doc_id") % 2 == 0, F.lit("axes")).otherwise(F.lit("no")), F.col("source"))
    return table(spark, sf, "documents").select("doc_id", X.is_category_nav(items).alias("is_nav"))


@register("h16_mashed_stats", "SELECT p_partkey, p_size % 3 <> 2 AS mashed FROM part")
def h16(spark, sf):
    k = F.col("p_size") % 3
    key = F.when(k == 0, F.lit("ScalingStrDDexC")).when(k == 1, F.lit("Phy116Mag0")).otherwise(F.lit("FP Cost"))
    return table(spark, sf, "part").select("p_partkey", X.is_mashed(key, F.lit("FP9")).alias("mashed"))


@register("h21_normalise", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS clean FROM documents")
def h21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalise(F.col("text")).alias("clean"))


@register("h22_doc_type", "SELECT doc_id, CASE WHEN source = 'src1' OR n_chars >= 50000 THEN 'walkthrough' ELSE 'page' END AS doc_type FROM documents")
def h22(spark, sf):
    title = F.when(F.col("source") == "src1", F.lit("Full Walkthrough")).otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", X.doc_type(title, F.col("n_chars")).alias("doc_type"))


@register("f12_keep_passage", r"SELECT doc_id FROM documents WHERE length(text) >= 80 AND NOT regexp_matches(text, '(?i)\[\s*other\s+\w+\s+go\s+here\s*\]')")
def f12(spark, sf):
    return table(spark, sf, "documents").filter(X.keep_passage(F.col("text"))).select("doc_id")


@register("f16_affirmation", r"""
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Yes please' WHEN 1 THEN 'ok so how' WHEN 2 THEN 'Sure, go ahead!' ELSE text END AS x FROM conversations)
SELECT conv_id, turn, turn % 4 IN (0, 2) AS affirms FROM t""")
def f16(spark, sf):
    k = F.col("turn") % 4
    x = F.when(k == 0, F.lit("Yes please")).when(k == 1, F.lit("ok so how")).when(k == 2, F.lit("Sure, go ahead!")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.is_affirmation(x).alias("affirms"))


@register("f17_superlative", r"""
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'weight_desc' WHEN 1 THEN 'fp_cost_asc' WHEN 2 THEN 'weight_asc' END AS sort, CASE turn % 4 WHEN 0 THEN 'Armor' WHEN 1 THEN 'Sorceries' END AS grp FROM conversations""")
def f17(spark, sf):
    k = F.col("turn") % 4
    x = F.when(k == 0, F.lit("What is the Heaviest armour?")).when(k == 1, F.lit("cheapest sorcery")).when(k == 2, F.lit("the lightest thing")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.superlative_sort(x).alias("sort"), X.superlative_group(x).alias("grp"))


@register("f19_dlc_flag", "SELECT doc_id, contains(lower(substr(CASE WHEN doc_id % 4 = 0 THEN 'In the Land of Shadow. ' ELSE '' END || text, 1, 2000)), 'land of shadow') AS dlc FROM documents")
def f19(spark, sf):
    lead = F.when(F.col("doc_id") % 4 == 0, F.lit("In the Land of Shadow. ")).otherwise(F.lit(""))
    return table(spark, sf, "documents").select("doc_id", X.is_dlc(F.concat(lead, F.col("text"))).alias("dlc"))


@register("w7_adjacent_sentences", r"""
WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s, unnest(range(len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) AS pos FROM documents)
SELECT doc_id, count(*) AS n_kept FROM (SELECT doc_id, lower(trim(s, ' ' || chr(10) || chr(9))) AS s, lag(lower(trim(s, ' ' || chr(10) || chr(9)))) OVER (PARTITION BY doc_id ORDER BY pos) AS b, pos FROM s) WHERE pos = 0 OR s IS DISTINCT FROM b GROUP BY doc_id""")
def w7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.drop_adjacent(X.sentences(F.col("text")))).cast("long").alias("n_kept"))
