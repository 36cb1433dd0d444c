"""Queries over authors' names and addresses."""

from __future__ import annotations

from ..plans.runtime import table
from .name_links import author_pairs, same_authors


def _labels(spark, d):
    return same_authors(table(spark, d, "commits"), table(spark, d, "name_forms"))


QUERIES = {
    "p1_found": lambda s, d: author_pairs(_labels(s, d)),
    "p1_authors": _labels,
}

ORACLES: dict[str, str] = {}
