"""Queries over texts with a wrong character encoding."""

from __future__ import annotations

from ..plans.runtime import table
from .mojibake import restore_texts

QUERIES = {
    "p8_found": lambda s, d: restore_texts(table(s, d, "documents")).where("garbled").select("doc_id"),
    "p8_restored": lambda s, d: restore_texts(table(s, d, "documents")).where("garbled").select("doc_id", "complete", "restored_text"),
}

ORACLES: dict[str, str] = {}
