"""The query plan: one source, a half-open time range, filters, group keys and metrics."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

MIN_MS, MAX_MS = -(1 << 63), (1 << 63) - 1


class QueryError(ValueError):
    """A query that isn't supported or can't be answered as asked."""


class Source(str, Enum):
    RAW = "usage_events"
    ROLLUP = "usage_rollup_hourly"


class Metric(str, Enum):
    SUM = "sum"
    COUNT = "count"
    #: Events behind a row: exact over rollups too, unlike COUNT, which counts rollup rows below the watermark.
    EVENTS = "events"


@dataclass(frozen=True)
class Filter:
    column: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class QueryPlan:
    source: Source = Source.RAW
    from_ms: int = MIN_MS
    to_ms: int = MAX_MS
    accounts: tuple[str, ...] | None = None
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    metrics: tuple[tuple[str, Metric], ...] = ()
    #: Over rollups, hours that the range cuts are read from raw events instead of being taken whole or dropped.
    exact_edges: bool = False
