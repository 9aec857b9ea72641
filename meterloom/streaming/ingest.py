"""Continuous ingest: every micro-batch goes through the store's idempotent ingest.

A watermark that drops late rows would lose usage, and
``dropDuplicatesWithinWatermark`` can't report conflicts, so neither is used:
late events are accepted, and a batch that runs again after a failure finds its own
events in the store and counts them as duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import hour_start
from ..schema import RAW_COLUMNS, RAW_SCHEMA
from ..sources.usage import normalise_dimensions
from ..store import UsageStore


def read_json_stream(spark, path: str, max_files: int = 100) -> DataFrame:
    """A stream of JSON-lines files that appear in a folder."""
    ddl = ", ".join(f"{f.name} {'string' if f.name == 'dimensions' else f.dataType.simpleString()}" for f in RAW_SCHEMA)
    raw = spark.readStream.schema(ddl).option("maxFilesPerTrigger", max_files).option("mode", "DROPMALFORMED").json(path)
    return normalise_dimensions(raw.where("event_id is not null"))


def ingest_stream(events: DataFrame, store: UsageStore, checkpoint: str, report: Callable[[int, dict], None] | None = None, flush_every: int = 10, **trigger) -> StreamingQuery:
    """Start ingest of a stream of events; ``report(batch_id, counts)`` is told what became of each batch."""

    def one(batch: DataFrame, batch_id: int) -> None:
        counts = store.ingest(batch.select(*RAW_COLUMNS))
        if flush_every and batch_id % flush_every == flush_every - 1:
            store.flush()
        if report:
            report(batch_id, counts)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_hourly_usage(events: DataFrame) -> DataFrame:
    """Running totals by account, meter and hour of a stream (complete mode: nothing is ever too late)."""
    return events.groupBy("account_id", "meter_id", hour_start().alias("hour_start_ms")).agg(F.sum("quantity").cast("decimal(38,0)").alias("quantity"), F.count(F.lit(1)).alias("count"))
