"""Filtered vector top-k with structural re-ranking, and rosters from metadata.

The scan filters before it scores, so filters reach the Parquet reader; the query vector is a
literal; ``orderBy().limit()`` keeps k rows a partition. Everything after that works on the
candidates, a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.plans.retrieval import FETCH_K, TOP_K, RetrievalPlan, any_of, attempts, conjunction, facet_predicates, shaped, superlative

# Fixed values.
SECTION_BOOST, CRUMB_BOOST, TYPE_BOOST, DIVERSITY_PENALTY, SUBJECT_BOOST = 0.05, 0.03, 0.05, 0.04, 0.06
PROFILES = {
    "drops": (("drops", "combat information", "overview"), ("bosses", "items"), ()),
    "strategy": (("fight strategy", "attacks & counters", "attacks", "combat", "strategy", "stats"), ("bosses",), ()),
    "location": (("location", "where to find", "overview"), ("locations",), ()),
    "dialogue": (("dialogue",), ("npcs",), ("dialogue",)),
    "lore": (("lore", "notes & trivia", "notes", "trivia", "story", "overview"), ("lore",), ()),
    "quest": (("quest", "questline", "walkthrough", "side quests"), ("npcs", "walkthrough"), ()),
    "summary": (("overview", "list", "all bosses", "main bosses", "achievement", "complete list", "full list", "all", "stats"), (), ("body", "item_desc")),
}
ROSTER_ROWS = 15


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def structural_boost(intent: str | None, section: Column, breadcrumb: Column, chunk_type: Column) -> Column:
    """What a chunk's heading, breadcrumb and type add for an intent."""
    if intent is None:
        return F.lit(0.0)
    sections, crumbs, types = PROFILES[intent]
    out = F.when(_contains_any(F.lower(section), sections), SECTION_BOOST).otherwise(0.0)
    out = out + F.when(_contains_any(F.lower(F.array_join(breadcrumb, " / ")), crumbs), CRUMB_BOOST).otherwise(0.0)
    return out + F.when(chunk_type.isin(*types) if types else F.lit(False), TYPE_BOOST).otherwise(0.0)


def diversity_penalty(page: str, order: list) -> Column:
    """From the third chunk of a page on, in the given order."""
    return F.when(F.row_number().over(Window.partitionBy(page).orderBy(*order)) > 2, -DIVERSITY_PENALTY).otherwise(0.0)


def keep_first(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each value of ``key`` in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def predicates(plan: RetrievalPlan, doc_type: str | None = None) -> list[Column]:
    out = [any_of(F.col("entities"), list(plan.entities), True)] if plan.entities else []
    for column, value in (("category", plan.category), ("chunk_type", plan.chunk_type), ("doc_type", doc_type)):
        if value:
            out.append(F.col(column) == value)
    return out + facet_predicates(plan.facets)


def retrieve(chunks: DataFrame, vector: list[float], plan: RetrievalPlan, fetch_k: int = FETCH_K, diversity: bool = True, doc_type: str | None = None) -> DataFrame:
    """The best ``plan.k`` chunks, with ``score``, ``boost``, ``final_score`` and ``rank``.

    Ties go by ``point_id``. Without boosts only k rows are fetched, so fewer distinct texts may come.
    """
    wanted = conjunction(predicates(plan, doc_type))
    scan = chunks.filter(wanted) if wanted is not None else chunks
    boosted = diversity or plan.intent is not None
    order = [F.desc("score"), F.asc("point_id")]
    found = scan.withColumn("score", dot(F.col("vector"), vector_literal(vector))).orderBy(*order).limit(fetch_k if boosted else plan.k)
    boost = structural_boost(plan.intent, F.col("section_heading"), F.col("breadcrumb"), F.col("chunk_type"))
    if diversity:
        boost = boost + diversity_penalty("url", order)
    if plan.entities:
        boost = boost + F.when(F.lower("subject").isin([e.lower() for e in plan.entities]), SUBJECT_BOOST).otherwise(0.0)
    ranked = found.withColumn("boost", boost).withColumn("final_score", F.col("score") + F.col("boost"))
    final = [F.desc("final_score"), *order]
    return keep_first(ranked, "raw_text", final).orderBy(*final).limit(plan.k).withColumn("rank", F.row_number().over(Window.orderBy(*final)))


def first_filled(frames: list[DataFrame]) -> DataFrame:
    """The first frame that has rows, else the last; asks for one row of each before it."""
    for frame in frames[:-1]:
        if frame.limit(1).count():
            return frame
    return frames[-1]


def run_plan(chunks: DataFrame, vector: list[float], plan: RetrievalPlan) -> tuple[DataFrame, DataFrame | None]:
    """The chunks and, where the plan asks for one, the roster of a shaped plan."""
    ready = shaped(plan)
    found = first_filled([retrieve(chunks, vector, p) for p in attempts(ready)])
    _, asked_group = superlative(plan.question)
    group = asked_group or ready.group
    if ready.sort:
        facet, _, direction = ready.sort.rpartition("_")
        tries = [top_by_facet(chunks, facet, group, None if group else plan.category, ready.facets, desc=direction == "desc")]
        if group:
            tries.append(top_by_facet(chunks, facet, None, plan.category, ready.facets, desc=direction == "desc"))
        return found, first_filled(tries)
    if group or (ready.facets and not plan.entities):
        return found, first_filled([enumerate_titles(chunks, group, c, ready.facets) for c in ([plan.category, None] if plan.category else [None])])
    return found, None


def _roster_scan(chunks: DataFrame, group: str | None, category: str | None, doc_type: str | None, facets: dict | None) -> DataFrame | None:
    wanted = ([F.array_contains("breadcrumb", group)] if group else []) + ([F.col("category") == category] if category else []) + facet_predicates(facets)
    wanted += [F.col("doc_type") == doc_type] if doc_type else []
    both = conjunction(wanted)
    return None if both is None else chunks.filter(both)


def enumerate_titles(chunks: DataFrame, group: str | None = None, category: str | None = None, facets: dict | None = None, doc_type: str | None = "page") -> DataFrame:
    """All distinct titles, upgrade suffixes cut, in code-point order; a group ``X Sets`` is the titles in X that end so.

    Exact however many chunks match; empty when nothing restricts the scan.
    """
    suffix = None
    if group and group.strip().lower().endswith(" sets"):
        group, suffix = group.strip()[: -len(" sets")].strip(), " Set"
    scan = _roster_scan(chunks, group.strip() if group else None, category, doc_type, facets)
    if scan is None:
        return chunks.limit(0).select(F.col("title"))
    scan = scan.filter(F.endswith("title", F.lit(suffix))) if suffix else scan
    title = F.trim(F.regexp_replace("title", r"\s*\+\d+$", ""))
    return scan.select(title.alias("title")).filter("title <> ''").distinct().orderBy("title")


def top_by_facet(chunks: DataFrame, facet: str, group: str | None = None, category: str | None = None, facets: dict | None = None, n: int = ROSTER_ROWS, desc: bool = True, doc_type: str | None = "page") -> DataFrame:
    """The ``n`` titles of the best facet values; ties by smallest ``point_id``, then title."""
    scan = _roster_scan(chunks, group, category, doc_type, facets)
    if scan is None:
        return chunks.limit(0).select("title", F.lit(None).cast("double").alias("value"))
    best = scan.filter(F.col(facet).isNotNull() & (F.col("title") != "")).groupBy("title").agg((F.max if desc else F.min)(facet).alias("value"), F.min("point_id").alias("_first"))
    return best.orderBy(F.desc("value") if desc else F.asc("value"), "_first", "title").limit(n).drop("_first")


def roster_text(group: str, titles: list[str], shown: int = ROSTER_ROWS) -> str:
    """One line for a prompt: ranked where a shown entry ends in a number in brackets."""
    import re

    head = titles[:shown]
    if any(re.search(r"\([\d.]+\)\s*$", t) for t in head):
        return f"RANKED LIST: {group}, best first, {len(titles)} in all. Top {len(head)}: {'; '.join(head)}."
    return f"COMPLETE LIST: {group}, {len(titles)} in all. {len(head)} of them: {', '.join(head)}."
