"""Schemas of usage events, hourly rollups and the flat export."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed values of the event model.
KINDS = ("Usage", "Correction", "Retraction")
MAX_DIMENSIONS = 16
HOUR_MS, DAY_MS = 3_600_000, 86_400_000

_S, _L, _Q = T.StringType(), T.LongType(), T.DecimalType(38, 0)

RAW_SCHEMA = T.StructType(
    [
        T.StructField("event_id", _S, False),
        T.StructField("kind", _S, False),
        T.StructField("correction_ref", T.StructType([T.StructField("original_event_id", _S), T.StructField("reason", _S)])),
        T.StructField("account_id", _S, False),
        T.StructField("subscription_id", _S),
        T.StructField("product_id", _S, False),
        T.StructField("meter_id", _S, False),
        T.StructField("timestamp_ms", _L, False),
        T.StructField("quantity", _Q, False),
        T.StructField("unit", _S, False),
        T.StructField("source", _S, False),
        T.StructField("model_id", _S),
        T.StructField("dimensions", T.MapType(_S, _S, False), False),
        T.StructField("ingested_at_ms", _L, False),
    ]
)
RAW_COLUMNS = RAW_SCHEMA.fieldNames()

ROLLUP_KEY = ["account_id", "subscription_id", "product_id", "meter_id", "model_id", "source", "unit", "hour_start_ms", "dimensions_canonical"]
ROLLUP_SCHEMA = T.StructType(
    [T.StructField(k, _L if k == "hour_start_ms" else _S, k in ("subscription_id", "model_id")) for k in ROLLUP_KEY]
    + [T.StructField("quantity_sum", _Q, False), T.StructField("event_count", _L, False), T.StructField("first_event_ms", _L, False), T.StructField("last_event_ms", _L, False)]
)

EXPORT_COLUMNS = ["event_id", "kind", "correction_original_event_id", "correction_reason", "account_id", "subscription_id", "product_id", "meter_id", "model_id", "timestamp_ms", "quantity", "unit", "source", "dimensions_canonical", "ingested_at_ms"]

#: Rows of one account and meter stand together in a segment, in time order.
CANONICAL_ORDER = ["account_id", "product_id", "meter_id", "coalesce(model_id, '')", "timestamp_ms"]
