"""Flat export of raw events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import canonical_dimensions
from ..schema import EXPORT_COLUMNS


def flat_events(raw: DataFrame) -> DataFrame:
    """The 15 flat columns of an export."""
    return raw.select(
        "*",
        F.col("correction_ref.original_event_id").alias("correction_original_event_id"),
        F.col("correction_ref.reason").alias("correction_reason"),
        canonical_dimensions().alias("dimensions_canonical"),
    ).select(*EXPORT_COLUMNS)


def export_parquet(raw: DataFrame, path: str, single_file: bool = False) -> None:
    """Write the flat events; as one file only if that is asked for, since it takes one task."""
    flat = flat_events(raw)
    (flat.coalesce(1) if single_file else flat).write.option("compression", "zstd").mode("overwrite").parquet(path)
