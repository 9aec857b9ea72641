"""Hourly rollups and statistics of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bucket_of, canonical_dimensions, hour_start
from ..schema import CANONICAL_ORDER, ROLLUP_KEY


def in_canonical_order(rows: DataFrame) -> DataFrame:
    """Rows with a bucket, dealt by ranges of the canonical order within buckets: a hot account or bucket is spread over tasks, and files follow each other."""
    order = ["bucket", *[F.expr(c) for c in CANONICAL_ORDER]]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def hourly_rollup(raw: DataFrame, *more: str) -> DataFrame:
    """A row for each key and hour (and columns ``more``): sum, count, first and last event time. Corrections net into the sum."""
    keyed = raw.select("*", hour_start().alias("hour_start_ms"), canonical_dimensions().alias("dimensions_canonical"))
    return keyed.groupBy(*more, *ROLLUP_KEY).agg(
        F.sum("quantity").cast("decimal(38,0)").alias("quantity_sum"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("timestamp_ms").alias("first_event_ms"),
        F.max("timestamp_ms").alias("last_event_ms"),
    )


def segment_statistics(events: DataFrame, *by: str) -> DataFrame:
    """Zone map of each group of rows: times, accounts, id sets, rows and quantity."""
    ids = lambda c: F.sort_array(F.collect_set(c))
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("timestamp_ms").alias("min_timestamp_ms"),
        F.max("timestamp_ms").alias("max_timestamp_ms"),
        F.min("account_id").alias("min_account"),
        F.max("account_id").alias("max_account"),
        ids("product_id").alias("products"),
        ids("meter_id").alias("meters"),
        ids("model_id").alias("models"),
        F.sum("quantity").cast("decimal(38,0)").alias("quantity_sum"),
    )


def with_bucket(events: DataFrame, buckets: int) -> DataFrame:
    return events.withColumn("bucket", bucket_of(buckets))


def rollup_lineage(raw: DataFrame) -> DataFrame:
    """Raw segments behind each hour and bucket; ``raw`` has ``bucket`` and ``segment_id``."""
    return raw.groupBy("bucket", hour_start().alias("hour_start_ms")).agg(F.sort_array(F.collect_set("segment_id")).alias("inputs"))
