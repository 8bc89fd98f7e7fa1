"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.catalog import table
from corpusweave.llm import decontamination, language, mixing, pii, quality, sharding, simhash, substrings, suffixes, toxicity
from corpusweave.llm.frames import cut, held_out, pick


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    sizes = cut(mixing.sized(docs))
    plan = mixing.make_plan(sizes)
    drawn = mixing.with_draws(sizes, plan).join(plan.source_table(spark), F.col("source").eqNullSafe(F.col("mix_source")))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce(F.size("draws"), F.lit(0))).cast("long").alias("taken"), F.col("draws.shard").alias("shards"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without the 100-byte strings that start earlier."""
    found = suffixes.without_repeats(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", *(f"suffixes.{c}" for c in ("n_bytes", "n_removed", "n_spans")), F.sha2("suffixes.kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot out of eight, under the law ``rows``."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = sharding.shard(docs)
    return out.select(
        "doc_id", (sharding.text_bytes() + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that a smaller document has."""
    found = substrings.without_repeats(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", "substrings.n_words", "substrings.n_removed", F.sha2(F.col("substrings.kept").cast("binary"), 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels outside the held-out rows."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score(pick(docs, "doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id among its near duplicates."""
    found = simhash.near_duplicates(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: counts and digests of the base kinds, and all spans."""
    seen = pii.detect(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    only = seen.select("doc_id", F.filter("pii", lambda s: s["place"] < len(base)).alias("base"), "pii")
    return only.select(
        "doc_id", *map(number, base),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the compression bands' verdict for every document."""
    found = quality.assess(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    failed = quality.base_failed()
    return found.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), (~failed & (F.col("quality.verdict") == "keep")).alias("kept"), "quality.ratio", "quality.verdict")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside the held-out rows."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out())
    found = language.identify(pick(docs, "doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS g FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
late AS (SELECT r, p FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
part AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM late)),
span AS (SELECT r, k, min(p) AS a, max(p) + 100 AS b FROM part GROUP BY r, k),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS g, md5(array_to_string(w[i:i + 49], ' ')) AS m FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g, m) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM late),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_suffixes, op3_sharding, op4_substrings, op5_toxicity, op6_simhash, op7_pii, op8_decontamination, op9_quality, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffixes": OP2_SQL, "op4_substrings": OP4_SQL, "op8_decontamination": OP8_SQL}
