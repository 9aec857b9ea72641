"""Ingest steps: validation, the closed-period gate, and classification into new, duplicate and conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import payload_hash, period_of
from ..schema import KINDS, MAX_DIMENSIONS

DEDUPE_TTL_MS = 7 * 86_400_000
#: Repeated ids of a batch that are broadcast, at most; with more, all events are shuffled by their ids.
FEW_IDS = 200_000


def validate(events: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: the first rule that an event breaks, else null."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        (empty("event_id"), "event_id is empty"),
        (empty("account_id"), "account_id is empty"),
        (empty("product_id"), "product_id is empty"),
        (empty("meter_id"), "meter_id is empty"),
        (F.coalesce("timestamp_ms", F.lit(0).cast("long")) <= 0, "timestamp_ms must be positive"),
        (F.size("dimensions") > MAX_DIMENSIONS, "too many dimensions"),
        (F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), "unknown kind"),
        ((F.col("kind") != "Usage") & F.col("correction_ref").isNull(), "correction_ref is required"),
        (F.col("quantity").isNull(), "quantity is missing"),
    ]
    reason = F.lit(None).cast("string")
    for broken, why in reversed(rules):
        reason = F.when(broken, F.lit(why)).otherwise(reason)
    return events.withColumn("reject_reason", reason)


def gate_closed(events: DataFrame, closed: DataFrame) -> DataFrame:
    """Adds ``reject_reason`` to usage events of closed periods; corrections and retractions pass.

    ``closed`` has ``account_id, period`` (``YYYY-MM``), one row for each closed
    account-month: the join decides by its size whether it is broadcast.
    """
    marks = closed.select(F.col("account_id").alias("__account"), F.col("period").alias("__period")).distinct()
    joined = events.withColumn("__month", period_of()).join(marks, (F.col("account_id") == F.col("__account")) & (F.col("__month") == F.col("__period")) & (F.col("kind") == "Usage"), "left")
    reason = F.when(F.col("__account").isNotNull(), F.lit("period is closed"))
    held = F.coalesce("reject_reason", reason) if "reject_reason" in events.columns else reason
    return joined.withColumn("reject_reason", held).drop("__account", "__period", "__month")


def dedupe_index(raw: DataFrame) -> DataFrame:
    """``event_id, payload_hash, ingested_at_ms`` of accepted events, of which the first decides."""
    return raw.select("event_id", payload_hash().alias("payload_hash"), "ingested_at_ms")


def repeated_ids(batch: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``id_hash`` of ids that the batch holds several times, or that the index holds too; other events are new without a comparison.

    Ids meet by 64-bit hashes, so nothing but those is shuffled; two ids of one hash are taken for repeated, which costs a comparison only.
    """
    ids = batch.select("event_id")
    if index is not None:
        ids = ids.unionByName(index.select("event_id").join(ids.distinct(), "event_id", "left_semi"))
    counted = ids.groupBy(F.xxhash64("event_id").alias("id_hash")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select("id_hash")


def with_ids(batch: DataFrame, hashes: DataFrame, held: bool) -> DataFrame:
    """Events whose ids are among ``hashes``, which is small, or those whose ids aren't."""
    return batch.join(F.broadcast(hashes), F.xxhash64("event_id") == hashes["id_hash"], "left_semi" if held else "left_anti")


def classify(batch: DataFrame, index: DataFrame | None = None, now_ms: int | None = None, ttl_ms: int = DEDUPE_TTL_MS) -> DataFrame:
    """Adds ``status``: ``new``, ``duplicate`` or ``conflict``.

    ``batch`` has a column ``batch_pos`` that orders it.  An id's first occurrence
    is compared with the index (within ``ttl_ms`` of ``now_ms``, if given), later
    ones with the first, or with what the index holds.
    """
    rows = batch.withColumn("payload_hash", payload_hash())
    first = rows.groupBy("event_id").agg(F.min_by(F.struct("batch_pos", "payload_hash"), F.col("batch_pos")).alias("first"))
    if index is not None:
        if now_ms is not None:
            index = index.where(F.col("ingested_at_ms") >= now_ms - ttl_ms)
        # only the batch's ids matter: a batch that is small is broadcast, and then the index isn't shuffled
        index = index.join(rows.select("event_id").distinct(), "event_id", "left_semi")
        held = index.groupBy("event_id").agg(F.min_by("payload_hash", F.struct("ingested_at_ms", "payload_hash")).alias("held"))
        first = first.join(held, "event_id", "left")
    else:
        first = first.withColumn("held", F.lit(None).cast("string"))
    rows = rows.join(first, "event_id")
    decisive = F.coalesce("held", "first.payload_hash")
    status = (
        F.when(F.col("held").isNull() & (F.col("batch_pos") == F.col("first.batch_pos")), F.lit("new"))
        .when(F.col("payload_hash") == decisive, F.lit("duplicate"))
        .otherwise(F.lit("conflict"))
    )
    return rows.withColumn("status", status).drop("first", "held", "payload_hash")


def number_batch(events: DataFrame) -> DataFrame:
    """Adds ``batch_pos``, the order in which the rows were read."""
    return events.withColumn("batch_pos", F.monotonically_increasing_id())


def first_by_id(events: DataFrame) -> DataFrame:
    """One row for each event_id: the first by account, product, meter, model, time and payload (cold dedupe)."""
    order = [F.col("account_id"), F.col("product_id"), F.col("meter_id"), F.coalesce("model_id", F.lit("")), F.col("timestamp_ms"), payload_hash()]
    ranked = events.withColumn("__rank", F.row_number().over(Window.partitionBy("event_id").orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def conflicting_ids(events: DataFrame) -> DataFrame:
    """Ids that occur with different payloads, and how many payloads each has."""
    counted = events.select("event_id", payload_hash().alias("p")).groupBy("event_id").agg(F.count_distinct("p").alias("payloads"))
    return counted.where("payloads > 1")
