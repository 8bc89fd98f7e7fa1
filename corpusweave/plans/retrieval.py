"""Retrieval plans: what a question asks for, as plain values, and the rules that shape it.

Nothing here touches data. Plans come from a caller (a language model or a person); the rules make
them safe before DataFrames are built from them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.text import AFFIRM_STARTERS, AFFIRM_WORDS, GRADES, SUPERLATIVE_GROUPS, SUPERLATIVES

# Fixed values.
TOP_K, FETCH_K, BROAD_K = 8, 40, 14
BROAD_INTENTS = ("summary", "quest")
FACET_KEYS = ("dlc", "weapon_type", "weak_to", "strong_vs", "weight_min", "weight_max", "fp_cost_min", "fp_cost_max")
SCALING_KEY = re.compile(r"scaling_(?:str|dex|int|fai|arc)_(?:min|max)")
SORTS = ("weight_desc", "weight_asc", "fp_cost_desc", "fp_cost_asc")
INTENTS = ("drops", "strategy", "location", "dialogue", "lore", "quest", "summary")
CHUNK_TYPES = ("body", "dialogue", "item_desc")
CATEGORIES = ("lore", "item", "boss", "quest", "location")
TONES = ("scholar", "cryptic")
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages:"


def clean_facets(facets: dict | None) -> dict | None:
    """Only known keys, and ``sort`` only with a known order; None when nothing is left."""
    if not isinstance(facets, dict):
        return None
    known = {k: v for k, v in facets.items() if k in FACET_KEYS or SCALING_KEY.fullmatch(str(k)) or (k == "sort" and v in SORTS)}
    return known or None


def grades(bound: str, at_least: bool) -> list[str]:
    """The grades on the named side of a bound, itself included; none for an unknown grade."""
    level = GRADES.get(str(bound).upper())
    return [g for g, v in GRADES.items() if level and (v >= level if at_least else v <= level)]


def facet_predicates(facets: dict | None, multi: tuple[str, ...] = ("weak_to",), breadcrumb: str = "breadcrumb") -> list[Column]:
    """One predicate for each usable facet; ``multi`` names array columns.

    Bounds that aren't numbers, unknown grades and empty values make none. Any grade facet, usable
    or not, also asks for weapons.
    """
    out: list[Column] = []
    for key, value in (facets or {}).items():
        side = key[-4:] if key.endswith(("_min", "_max")) else ""
        column = F.col(key[:-4] if side else key)
        if side and key.startswith("scaling_"):
            if letters := grades(value, side == "_min"):
                out.append(column.isin(letters))
        elif side:
            try:
                bound = float(value)
            except (TypeError, ValueError):
                continue
            out.append(column >= bound if side == "_min" else column <= bound)
        elif isinstance(value, (list, tuple)):
            if usable := [v for v in value if v not in (None, "")]:
                out.append(any_of(column, usable, key in multi))
        elif value not in (None, ""):
            out.append(any_of(column, [value], key in multi))
    if any(str(k).startswith("scaling_") for k in facets or {}):
        out.append(F.array_contains(breadcrumb, "Weapons"))
    return out


def any_of(column: Column, values: list, multi: bool) -> Column:
    """Whether a value is among ``values``, or an array has one of them."""
    return F.arrays_overlap(column, F.array(*map(F.lit, values))) if multi else column.isin(values)


def conjunction(predicates: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, predicates) if predicates else None


@dataclass(frozen=True)
class RetrievalPlan:
    """What to fetch for one question; ``choices`` are the caller's picks among candidates, by mention."""

    question: str
    needs_retrieval: bool = True
    mentions: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    intent: str | None = None
    chunk_type: str | None = None
    category: str | None = None
    tone: str = "scholar"
    query: str | None = None
    group: str | None = None
    facets: dict | None = None
    sort: str | None = None
    k: int = TOP_K
    choices: dict = field(default_factory=dict)
    notes: tuple[str, ...] = ()

    def __post_init__(self):
        if not 1 <= len(self.question) <= 2000:
            raise ValueError("a question has 1 to 2000 characters")
        if not 1 <= self.k <= 20:
            raise ValueError("k is 1 to 20")
        for value, allowed in ((self.intent, INTENTS), (self.chunk_type, CHUNK_TYPES), (self.category, CATEGORIES), (self.tone, TONES)):
            if value is not None and value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")


def is_affirmation(text: str) -> bool:
    words = re.findall("[a-z]+", text.strip().lower())
    return bool(words) and len(text.strip()) <= 25 and words[0] in AFFIRM_STARTERS and set(words) <= set(AFFIRM_WORDS)


def last_user_turn(history: str) -> str | None:
    """The last non-empty ``User:`` line of a rendered history."""
    said = [line.strip()[5:].strip() for line in history.splitlines() if line.strip().lower().startswith("user:")]
    return (said[-1] or None) if said else None


def superlative(question: str) -> tuple[str | None, str | None]:
    """The order and group that ``heaviest``, ``lightest`` or ``cheapest`` asks for."""
    found = re.search(r"\b(heaviest|lightest|cheapest)\b", question or "", re.I)
    if not found:
        return None, None
    return dict(SUPERLATIVES)[found[1].lower()], next((g for p, g in SUPERLATIVE_GROUPS if re.search(p, question, re.I)), None)


def guarded(plan: RetrievalPlan, history: str = "") -> RetrievalPlan:
    """Retrieval is forced where anything in the plan needs data, and for a bare yes in a conversation."""
    yes = bool(history) and is_affirmation(plan.question)
    need = plan.needs_retrieval or bool(plan.entities or plan.group or plan.facets) or plan.intent == "summary" or yes
    query = plan.query or (last_user_turn(history) if yes else None)
    return replace(plan, needs_retrieval=need, query=query)


def shaped(plan: RetrievalPlan) -> RetrievalPlan:
    """The plan as it runs: wider for broad intents, relaxed where filters contradict, facets whitelisted, origin dropped."""
    notes, facets = list(plan.notes), dict(clean_facets(plan.facets) or {})
    sort = facets.pop("sort", None)
    asked, _ = superlative(plan.question)
    if asked and not sort:
        sort = asked
        notes.append(f"order {asked} from the question")
    group = plan.group
    if group and any(group.strip().lower() == e.strip().lower() for e in plan.entities):
        group = None
        notes.append("the group is the entity: a lookup")
    entities = () if group else plan.entities
    query = (plan.query or "").lower()
    kept = tuple(e for e in entities if f"from {e.lower()}" not in query and f"from the {e.lower()}" not in query)
    if kept != entities:
        notes.append("an origin is no filter")
    return replace(
        plan, k=max(plan.k, BROAD_K) if plan.intent in BROAD_INTENTS else plan.k,
        category=plan.category if not plan.entities and plan.intent not in BROAD_INTENTS else None,
        chunk_type=plan.chunk_type if plan.chunk_type == "dialogue" else None,
        facets=facets or None, sort=sort, group=group, entities=kept, notes=tuple(notes),
    )


def attempts(plan: RetrievalPlan) -> list[RetrievalPlan]:
    """A shaped plan's filters in order: with entities, then without; with facets, then without."""
    if plan.entities:
        return [replace(plan, facets=None), replace(plan, entities=())]
    return [plan, replace(plan, facets=None)] if plan.facets else [plan]


def bind_choices(shortlists: dict[str, list[tuple[str, float]]], choices: dict[str, int] | None = None) -> list[str]:
    """Names from shortlists: dominant ones at once, the others by the caller's index, else the first.

    Index 0 is none, unless a candidate is the mention itself; an index out of range is the first.
    """
    norm = lambda s: " ".join(s.lower().replace(",", " ").split())
    by_norm = {norm(k): v for k, v in (choices or {}).items()}
    sure, chosen = [], []
    for mention, found in shortlists.items():
        if not found:
            continue
        names, top = [n for n, _ in found], found[0][1]
        gap = top - found[1][1] if len(found) > 1 else 100.0
        if len(found) == 1 or (top >= 95 and gap >= 5) or (top >= 90 and gap >= 10):
            sure.append(names[0])
            continue
        pick = (choices or {}).get(mention, by_norm.get(norm(mention)))
        if pick == 0 and choices:
            chosen += [n for n in names if norm(n) == norm(mention)][:1]
        else:
            chosen.append(names[pick - 1] if pick and 1 <= pick <= len(names) else names[0])
    return list(dict.fromkeys(sure + chosen))
