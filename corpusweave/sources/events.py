"""Structured log lines and server-sent event frames as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_line(severity: Column, time: Column, logger: str, message: Column, fields: dict[str, Column]) -> Column:
    """One JSON object a row; extra fields stand beside the fixed ones."""
    return F.to_json(F.struct(severity.alias("severity"), time.alias("time"), F.lit(logger).alias("logger"), message.alias("message"), *(v.alias(k) for k, v in fields.items())))


def frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def frames(stream: Column) -> Column:
    """(event, data) of a text of frames."""
    parts = F.filter(F.split(stream, "\n\n"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract(p, r"(?m)^data: (.*)$", 1).alias("data")))


def answer_frames(meta: Column, tokens: Column, sources: Column, images: Column, error: Column) -> Column:
    """An answer's frames in order: meta, tokens, then sources, images and done, or an error."""
    head = F.concat(F.array(frame(F.lit("meta"), meta)), F.transform(tokens, lambda t: frame(F.lit("token"), F.to_json(F.struct(t.alias("text"))))))
    tail = F.array(frame(F.lit("sources"), sources), frame(F.lit("images"), images), frame(F.lit("done"), F.lit("{}")))
    return F.array_join(F.when(error.isNull(), F.concat(head, tail)).otherwise(F.concat(head, F.array(frame(F.lit("error"), error)))), "")
