"""Queries over document texts as tokens of a public tokenizer."""

from __future__ import annotations

from ..plans.runtime import table
from .bpe import count_tokens, encode_texts
from .packing import fill_summary, pack_documents

QUERIES = {
    "p6_ids": lambda s, d: encode_texts(table(s, d, "documents")),
    "p6_token_counts": lambda s, d: count_tokens(table(s, d, "documents")),
    "p7_containers": lambda s, d: pack_documents(table(s, d, "documents")),
    "p7_fill_summary": lambda s, d: fill_summary(pack_documents(table(s, d, "documents"))),
}

ORACLES: dict[str, str] = {}
