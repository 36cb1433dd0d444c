"""Queries and oracles of the store operators."""

from __future__ import annotations

from ..operators.store_queries import OPS
from .model import commit_rows, duck, frames
from .store_sql import OPS as SQL

QUERIES = {n: (lambda s, d, f=f: f(frames(s, d), commit_rows(s, d))) for n, f in OPS.items()}
ORACLES = {n: duck(SQL[n]) for n in OPS}
