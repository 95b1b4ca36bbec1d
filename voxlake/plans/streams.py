"""Queries of the ingest: the batch form of what a stream computes."""

from __future__ import annotations

from ..functions.scalar import r6
from ..streaming.ingest import windowed_statistics
from .views import table

QUERIES = [
    (
        "s_windowed_statistics",
        lambda s, d: windowed_statistics(table(s, d, "events"), ["event_type"]).select("event_type", "window_start", "n", *[r6(c).alias(c) for c in ("mean", "lo", "hi")]),
        "SELECT event_type, date_trunc('hour', ts) AS window_start, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi FROM events GROUP BY ALL",
    ),
]
