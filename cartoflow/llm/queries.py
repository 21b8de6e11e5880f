"""All queries and oracles of this subpackage, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("pii", "secrets", "quality", "bpe", "media", "langid", "store", "simhash", "suffix", "mixing")


def all_queries() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in _MODULES:
        module = import_module(f".{name}", __package__)
        queries |= module.QUERIES
        sql |= getattr(module, "SQL", {})
    return queries, sql
