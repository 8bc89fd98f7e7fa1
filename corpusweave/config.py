"""Settings given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE = ("1", "true", "yes", "on")


def as_bool(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in TRUE


def bool_column(value: Column, default: bool = False) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUE), F.lit(default))


def tier(spec: str) -> tuple[str, str | None]:
    """``provider:model``, parted at the first colon; a provider alone has no model."""
    provider, colon, model = spec.strip().partition(":")
    return provider.strip().lower(), model.strip() if colon else None


def tier_columns(spec: Column) -> tuple[Column, Column]:
    model = F.when(F.contains(spec, F.lit(":")), F.trim(F.regexp_extract(spec, "^[^:]*:(.*)$", 1)))
    return F.lower(F.trim(F.substring_index(spec, ":", 1))), model


def first_answer(specs: list[str], ask, retryable: tuple[type[Exception], ...], empty=("", None)):
    """The first tier's answer that isn't empty; a retryable error or an empty answer goes to the next tier, any other error is raised."""
    last: Exception | None = None
    for spec in specs:
        try:
            answer = ask(*tier(spec))
        except retryable as error:
            last = error
            continue
        if answer not in empty:
            return answer
    raise last or ValueError("no tier answered")
