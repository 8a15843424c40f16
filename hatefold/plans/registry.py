"""Registry of the queries bound to the driver tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["q_lexicon", "q_metrics", "q_corpus", "q_augment", "q_hangul", "q_io", "q_models", "q_stream", "q_checks"]


def _mods():
    return [import_module(f"hatefold.plans.{m}") for m in _MODULES]


def all_queries() -> dict:
    out = {}
    for m in _mods():
        out.update(m.QUERIES)
    return out


def all_oracle_sql() -> dict:
    out = {}
    for m in _mods():
        out.update(m.ORACLE)
    return out
