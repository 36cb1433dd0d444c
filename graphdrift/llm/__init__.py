"""Operators for training-data pipelines over commits, source files and documents."""

from __future__ import annotations

import importlib

_QUERY_MODULES = ("term_queries", "token_queries", "source_queries", "encoding_queries", "name_queries")


def query_modules() -> list:
    return [importlib.import_module(f"{__name__}.{m}") for m in _QUERY_MODULES]
