"""Queries of this subpackage and, where SQL can say them, their SQL forms."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

MODULES = ["pieces", "lines", "contamination", "repeats", "pitman_yor", "pseudonyms", "toxicity", "simhash", "idfiles", "warc", "hashtree", "turns", "periods"]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tapeworks.llm.{m}")
