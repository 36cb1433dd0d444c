"""Queries that use the events table as a feed of file changes: a user is a file, its events are changes in time."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import incremental as I
from .runtime import ensure_checkpoint_dir, table

_CHANGES = [
    "concat('r', user_id % 7) AS repo_id",
    "concat('f', user_id) AS path",
    "event_id AS seq",
    "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op",
    "concat('u', user_id % 50) AS package_name",
    "array(event_type) AS targets",
]


def _batch(s, d):
    return I.edge_weights(I.signed_changes_batch(table(s, d, "events").selectExpr(*_CHANGES)))


def _stream(s, d):
    ensure_checkpoint_dir(s)
    base = s.sparkContext._jsc.sc().getCheckpointDir().get()
    run = f"stream-{uuid.uuid4().hex}"
    schema = table(s, d, "events").schema
    feed = s.readStream.schema(schema).parquet(f"{d}/events.parquet*").selectExpr(*_CHANGES)
    I.run_available(feed, f"{base}/{run}/out", f"{base}/{run}/log")
    return I.edge_weights(s.read.parquet(f"{base}/{run}/out").drop("batch"))


QUERIES = {"inc_stream": _stream, "inc_stream_batch": _batch}
_SQL = """
WITH c AS (SELECT 'r' || (user_id % 7) AS repo_id, 'f' || user_id AS path, event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE 'u' || (user_id % 50) END AS p, event_type AS t FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY seq DESC) AS rn FROM c)
SELECT repo_id, p AS from_module, t AS to_module, count(*) AS weight FROM last WHERE rn = 1 AND p IS NOT NULL GROUP BY 1, 2, 3"""
ORACLES = {"inc_stream": _SQL, "inc_stream_batch": _SQL}
