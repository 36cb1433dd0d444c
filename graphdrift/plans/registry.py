"""The core's query modules; each has QUERIES and ORACLES."""

from __future__ import annotations

from . import clusters, events, extraction, extras, graph, history, scalars, scoring, state, store


def modules() -> list:
    return [history, scalars, store, graph, scoring, state, clusters, extraction, events, extras]
