"""Derived columns: time buckets, canonical dimensions, hashes, and the resolver of names in queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_MS, HOUR_MS, RAW_COLUMNS


def hour_start(ts: str = "timestamp_ms") -> Column:
    return F.expr(f"({ts} div {HOUR_MS}) * {HOUR_MS}")


def day_start(ts: str = "timestamp_ms") -> Column:
    return F.expr(f"({ts} div {DAY_MS}) * {DAY_MS}")


def period_of(ts: str = "timestamp_ms") -> Column:
    """UTC month of an event time, as ``YYYY-MM``; independent of the session's zone."""
    return F.date_format(F.timestamp_add("MILLISECOND", F.col(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM")


def canonical_dimensions(dimensions: str = "dimensions") -> Column:
    """JSON text of the dimensions in key order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(dimensions))))


def payload_hash() -> Column:
    """Digest of an event without its ingest time."""
    fields = [canonical_dimensions().alias(c) if c == "dimensions" else F.col(c) for c in RAW_COLUMNS if c != "ingested_at_ms"]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def bucket_of(buckets: int, account: str = "account_id") -> Column:
    return F.pmod(F.xxhash64(account), F.lit(max(1, buckets))).cast("int") if buckets else F.lit(0)


#: Names of a query that are columns; ``hour_start_ms`` and ``day`` are derived, every other name is a dimension.
PLAIN = ("account_id", "subscription_id", "product_id", "meter_id", "model_id", "source", "unit", "kind")
#: Event columns that aren't dimensions and can't be compared for equality.
UNFILTERABLE = ("timestamp_ms", "hour_start_ms", "day", "event_id", "quantity", "ingested_at_ms", "correction_ref", "dimensions")


def group_key(name: str) -> Column:
    """A group key as text; null and missing become empty."""
    if name in PLAIN:
        return F.coalesce(F.col(name), F.lit(""))
    if name == "hour_start_ms":
        return hour_start().cast("string")
    if name == "day":
        return day_start().cast("string")
    return F.coalesce(F.try_element_at("dimensions", F.lit(name)), F.lit(""))


def filter_value(name: str) -> Column:
    """What a filter compares; null never matches."""
    return F.col(name) if name in PLAIN else F.try_element_at("dimensions", F.lit(name))
