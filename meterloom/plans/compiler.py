"""From a query plan and its inputs to a DataFrame.

Catalyst does the rest: filters and columns reach the Parquet scan, and an
aggregation is partial before its one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import filter_value, group_key
from ..schema import HOUR_MS, RAW_COLUMNS
from .query import Metric, QueryError, QueryPlan, Source


def in_range(df: DataFrame, column: str, from_ms: int, to_ms: int) -> DataFrame:
    """Rows of ``[from_ms, to_ms)``."""
    return df.where((F.col(column) >= from_ms) & (F.col(column) < to_ms))


def rollup_as_events(rollups: DataFrame) -> DataFrame:
    """Rollup rows in the shape of events: the sum is the quantity, the hour its time, and ``events`` says how many stand behind it."""
    return rollups.select(
        F.lit("").alias("event_id"),
        F.lit("Usage").alias("kind"),
        F.lit(None).cast("struct<original_event_id:string,reason:string>").alias("correction_ref"),
        "account_id",
        "subscription_id",
        "product_id",
        "meter_id",
        F.col("hour_start_ms").alias("timestamp_ms"),
        F.col("quantity_sum").alias("quantity"),
        "unit",
        "source",
        "model_id",
        F.from_json("dimensions_canonical", "map<string,string>").alias("dimensions"),
        F.col("last_event_ms").alias("ingested_at_ms"),
        F.col("event_count").alias("events"),
    )


def stitch(raw: DataFrame, rollups: DataFrame, watermark_ms: int, from_ms: int, to_ms: int, exact_edges: bool = False) -> DataFrame:
    """Sealed hours from rollups below the watermark, and raw events from there on."""
    tail = in_range(raw, "timestamp_ms", max(from_ms, watermark_ms), to_ms).withColumn("events", F.lit(1).cast("long"))
    low, high = from_ms, min(to_ms, watermark_ms)
    edges = []
    if exact_edges and low < high:
        whole_low, whole_high = -(-low // HOUR_MS) * HOUR_MS, high // HOUR_MS * HOUR_MS
        if whole_low >= whole_high:
            edges.append((low, high))
        else:
            edges += [x for x in ((low, whole_low), (whole_high, high)) if x[0] < x[1]]
        low, high = whole_low, whole_high
    sealed = rollup_as_events(in_range(rollups, "hour_start_ms", low, high))
    parts = sealed.unionByName(tail)
    for a, b in edges:
        parts = parts.unionByName(in_range(raw, "timestamp_ms", a, b).withColumn("events", F.lit(1).cast("long")))
    return parts


def _filtered(df: DataFrame, plan: QueryPlan) -> DataFrame:
    if plan.accounts is not None:
        df = df.where(F.col("account_id").isin(list(plan.accounts)))
    for f in plan.filters:
        df = df.where(filter_value(f.column).isin(list(f.values)))
    return df


def _metric(label: str, metric: Metric):
    if metric is Metric.SUM:
        return F.coalesce(F.sum("quantity"), F.lit(0)).cast("decimal(38,0)").alias(label)
    if metric is Metric.COUNT:
        return F.count(F.lit(1)).alias(label)
    return F.coalesce(F.sum("events"), F.lit(0).cast("long")).alias(label)


def compile_plan(plan: QueryPlan, raw: DataFrame, rollups: DataFrame | None = None, watermark_ms: int = 0) -> DataFrame:
    """The plan over raw events, or over rollups stitched to the raw tail.

    Sums are decimals and counts longs; group keys are text, as ``''`` stands for a
    null or missing one.  An empty range gives one row of zeros without group keys,
    and none with them.
    """
    if plan.source is Source.ROLLUP and rollups is not None:
        if "kind" in plan.group_by or any(f.column == "kind" for f in plan.filters):
            raise QueryError("`kind` is not kept in rollups; use usage_events")
        rows = stitch(raw, rollups, watermark_ms, plan.from_ms, plan.to_ms, plan.exact_edges)
    else:
        rows = in_range(raw, "timestamp_ms", plan.from_ms, plan.to_ms).withColumn("events", F.lit(1).cast("long"))
    rows = _filtered(rows, plan)
    keys = [group_key(k).alias(k) for k in plan.group_by]
    metrics = [_metric(label, m) for label, m in plan.metrics]
    if keys and metrics:
        return rows.groupBy(*keys).agg(*metrics)
    if keys:
        return rows.select(*keys).distinct()
    if metrics:
        return rows.agg(*metrics)
    return rows.select(*RAW_COLUMNS)
