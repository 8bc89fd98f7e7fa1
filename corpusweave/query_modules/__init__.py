"""Registered queries, one module for each part of the engine; importing this registers them."""

from corpusweave.query_modules import landing, retrieval, tables, texts  # noqa: F401
