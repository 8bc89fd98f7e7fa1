"""The plan rules over tables of questions, in Arrow batches: a row in, the rule's outcome out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.config import first_answer
from corpusweave.plans.retrieval import RetrievalPlan, bind_choices, clean_facets, guarded, shaped


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _names(value) -> tuple[str, ...]:
    return () if value is None else tuple(value)


PLAN = T.StructType([T.StructField("needs_retrieval", T.BooleanType()), T.StructField("k", T.IntegerType()), T.StructField("category", T.StringType()), T.StructField("chunk_type", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType()))])


@F.pandas_udf(PLAN)
def planned(question: pd.Series, needs: pd.Series, entities: pd.Series, intent: pd.Series, category: pd.Series, chunk_type: pd.Series, query: pd.Series) -> pd.DataFrame:
    """Each row's plan after the guard and the shaping rules."""
    plans = [
        shaped(guarded(RetrievalPlan(q, needs_retrieval=bool(n), entities=_names(e), intent=_text(i), category=_text(c), chunk_type=_text(t), query=_text(x))))
        for q, n, e, i, c, t, x in zip(question, needs, entities, intent, category, chunk_type, query, strict=True)
    ]
    return pd.DataFrame({"needs_retrieval": [p.needs_retrieval for p in plans], "k": [p.k for p in plans], "category": [p.category for p in plans], "chunk_type": [p.chunk_type for p in plans], "entities": [list(p.entities) for p in plans]})


@F.pandas_udf(T.StringType())
def known_facets(facets: pd.Series) -> pd.Series:
    """The usable facets of a JSON object, keys in order; null when nothing is left or it is none."""

    def one(x) -> str | None:
        try:
            kept = clean_facets(json.loads(x)) if isinstance(x, str) else None
        except ValueError:
            kept = None
        return json.dumps(kept, sort_keys=True) if kept else None

    return facets.map(one)


@F.pandas_udf(T.StringType())
def tier_answer(specs: pd.Series, outcomes: pd.Series) -> pd.Series:
    """The answer of the first tier that gives one, as ``provider/model``.

    ``outcomes`` says what each tier did: ``ok``, ``empty``, ``retry`` (an error that passes on) or
    any other error, which ends the search. Null when no tier answered.
    """

    class Retry(Exception):
        pass

    def one(tiers, done) -> str | None:
        left = iter(done)

        def ask(provider: str, model: str | None) -> str:
            outcome = next(left)
            if outcome == "retry":
                raise Retry
            if outcome not in ("ok", "empty"):
                raise RuntimeError(outcome)
            return f"{provider}/{model}" if outcome == "ok" else ""

        try:
            return first_answer(list(tiers), ask, (Retry,))
        except (Retry, RuntimeError, ValueError):
            return None

    return pd.Series([one(a, b) for a, b in zip(specs, outcomes, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def bound(mention: pd.Series, names: pd.Series, scores: pd.Series, pick: pd.Series) -> pd.Series:
    """The names that one mention's shortlist and the caller's pick (an index, from 1) leave."""
    rows = zip(mention, names, scores, pick, strict=True)
    return pd.Series([bind_choices({m: list(zip(n, map(float, s), strict=True))}, None if pd.isna(p) else {m: int(p)}) for m, n, s, p in rows])
