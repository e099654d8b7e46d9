"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

from tillroll.llm.common import QueryFn

MODULES = (
    "decontaminate",
    "url_trust",
    "repetition",
    "viterbi",
    "html_main",
    "mixing",
    "sharding",
    "chat",
    "ngram_join",
    "secrets",
    "pieces",
    "periodic",
    "whitening",
)


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"tillroll.llm.{name}"), kind)
    return found


def queries() -> dict[str, QueryFn]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
