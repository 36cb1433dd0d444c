"""Queries over the kinds of source files."""

from __future__ import annotations

from ..plans.runtime import table
from .source_kinds import file_kinds, hand_written


def _kinds(spark, d):
    return file_kinds(table(spark, d, "source_files"), table(spark, d, "upstream_files"))


QUERIES = {
    "p5_found": lambda s, d: _kinds(s, d).where("kind != 'hand_written'").select("file_id"),
    "p5_file_kinds": _kinds,
    "p5_hand_written": lambda s, d: hand_written(table(s, d, "dependency_edges"), table(s, d, "source_files"), table(s, d, "upstream_files")),
}

ORACLES: dict[str, str] = {}
