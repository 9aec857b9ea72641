"""Explain, verify, adjustments and reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import in_range, rollup_as_events

EXPLAIN_KEYS = ("product_id", "meter_id", "model_id", "source", "unit")


def explain_lines(events: DataFrame) -> DataFrame:
    """Breakdown of events, or of stitched rollups, by product, meter, model, source and unit."""
    keys = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in EXPLAIN_KEYS]
    return events.groupBy(*keys).agg(F.sum("quantity").cast("decimal(38,0)").alias("quantity"), F.count(F.lit(1)).alias("count"))


def drift(raw: DataFrame, rollups: DataFrame, from_ms: int, to_ms: int, watermark_ms: int) -> DataFrame:
    """One row: the raw total, the total by rollups and the raw tail, and their difference."""
    signed = in_range(raw, "timestamp_ms", from_ms, to_ms).select("quantity", (F.col("timestamp_ms") >= watermark_ms).alias("tail"))
    both = signed.select(F.col("quantity").alias("raw"), F.when(F.col("tail"), F.col("quantity")).alias("rolled")).unionByName(
        rollup_as_events(in_range(rollups, "hour_start_ms", from_ms, min(to_ms, watermark_ms))).select(F.lit(None).cast("decimal(38,0)").alias("raw"), F.col("quantity").alias("rolled"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)")
    totals = both.agg(total("raw").alias("raw_total"), total("rolled").alias("rollup_total"))
    gap = (F.col("raw_total") - F.col("rollup_total")).cast("decimal(38,0)")
    return totals.select("raw_total", "rollup_total", gap.alias("drift"), (gap == 0).alias("matches"), F.lit(to_ms <= watermark_ms).alias("period_sealed"))


def adjustments(raw: DataFrame, account_id: str, from_ms: int, to_ms: int, after_ms: int | None = None) -> DataFrame:
    """Corrections and retractions of an account in a range, and ingested after ``after_ms`` if that is given."""
    rows = in_range(raw, "timestamp_ms", from_ms, to_ms).where((F.col("account_id") == account_id) & F.col("kind").isin("Correction", "Retraction"))
    return rows if after_ms is None else rows.where(F.col("ingested_at_ms") > after_ms)


def orphan_corrections(raw: DataFrame) -> DataFrame:
    """Corrections and retractions whose original event isn't there."""
    marked = raw.where("kind <> 'Usage'").select("event_id", "kind", F.col("correction_ref.original_event_id").alias("original_event_id"))
    ids = raw.select(F.col("event_id").alias("original_event_id"))
    return marked.join(ids, "original_event_id", "left_anti").select("event_id", "kind", "original_event_id")


def top_accounts(raw: DataFrame, meter_id: str, from_ms: int, to_ms: int, n: int = 100) -> DataFrame:
    """Accounts with the largest quantity of a meter in a range."""
    rows = in_range(raw, "timestamp_ms", from_ms, to_ms).where(F.col("meter_id") == meter_id)
    totals = rows.groupBy("account_id").agg(F.sum("quantity").cast("decimal(38,0)").alias("quantity"))
    return totals.orderBy(F.desc("quantity"), "account_id").limit(n)
