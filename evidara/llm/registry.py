"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("decontaminate", "substrings", "jaccard", "packing", "ann", "suffixes", "toxicity", "langid", "tokencounts", "linededup")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __package__).QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f".{m}", __package__).ORACLES.items()}
