"""The engine's queries over the standard tables, and the same in SQL.

Time zero of the ``events`` table is 2024-01-01; the watermark of stitched
queries is 2024-01-15, both in UTC.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.expressions import bucket_of, canonical_dimensions, period_of
from .operators import audit, ingest, rollup
from .plans.compiler import compile_plan, stitch
from .plans.query import Filter, Metric, QueryPlan, Source
from .plans.sql import parse_sql
from .sources.export import flat_events
from .sources.usage import events_as_usage, lineitem_as_usage
from .store import UsageStore

WATERMARK = 1_705_276_800_000
JAN_1, JAN_8, JAN_22, FEB_1 = 1_704_067_200_000, 1_704_672_000_000, 1_705_881_600_000, 1_706_745_600_000
SUM_COUNT = (("quantity", Metric.SUM), ("count", Metric.COUNT))

#: Usage rows in DuckDB; the oracle of each query selects from it.
USAGE = """u as (select concat('evt_', event_id) as event_id, event_id as n,
  case when event_id % 20 = 0 then 'Correction' when event_id % 50 = 7 then 'Retraction' else 'Usage' end as kind,
  case when event_id % 20 = 0 or event_id % 50 = 7 then concat('evt_', event_id - 1) end as original,
  concat('acc_', user_id) as account_id, case when user_id % 5 = 0 then null else concat('sub_', user_id) end as subscription_id,
  concat('prod_', event_id % 3) as product_id, event_type as meter_id, epoch_us(ts) // 1000 as timestamp_ms,
  (case when event_id % 20 = 0 or event_id % 50 = 7 then -1 else 1 end) * cast(round(value * 100) as bigint) as quantity,
  'unit' as unit, concat('src_', event_id % 2) as source, case when event_id % 7 = 0 then null else concat('m', event_id % 4) end as model_id,
  json_extract_string(props, '$.k') as k, epoch_us(ts) // 1000 + 5 as ingested_at_ms from events)"""
_HOUR, _DAY = "(timestamp_ms // 3600000) * 3600000", "(timestamp_ms // 86400000) * 86400000"
_KEYS = "account_id, subscription_id, product_id, meter_id, model_id, source, unit, k"
_ROLLED = f"r as (select {_KEYS}, {_HOUR} as hour_start_ms, sum(quantity) as quantity_sum, count(*) as event_count, min(timestamp_ms) as first_event_ms, max(timestamp_ms) as last_event_ms from u group by all)"
#: Sealed hours and the raw tail, as stitched rows.
_STITCHED = f"s as (select {_KEYS}, hour_start_ms as timestamp_ms, quantity_sum as quantity, event_count as events from r where hour_start_ms < {WATERMARK} union all select {_KEYS}, timestamp_ms, quantity, 1 from u where timestamp_ms >= {WATERMARK})"

_found: dict = {}
_oracles: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        _found[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return add


def _with(body: str, *parts: str) -> str:
    return f"with {', '.join([USAGE, *parts])} {body}"


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    """Decimals as longs, as DuckDB's side has them."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns or ("quantity",)})


def _raw(spark, sf_dir, **plan) -> DataFrame:
    return compile_plan(QueryPlan(**plan), events_as_usage(spark, sf_dir))


def _sealed(spark, sf_dir, watermark: int = WATERMARK, **plan) -> DataFrame:
    raw = events_as_usage(spark, sf_dir)
    return compile_plan(QueryPlan(source=Source.ROLLUP, **plan), raw, rollup.hourly_rollup(raw.where(F.col("timestamp_ms") < watermark)), watermark)


def _sql(spark, sf_dir, text: str) -> DataFrame:
    return _whole(compile_plan(parse_sql(text), events_as_usage(spark, sf_dir)))


_EVENT = "event_id, kind, account_id, subscription_id, product_id, meter_id, timestamp_ms, quantity, unit, source, model_id, ingested_at_ms"


def _flat(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in _EVENT.split(",")]
    return _whole(df).select(*names, F.col("dimensions")["k"].alias("k"), F.col("correction_ref.original_event_id").alias("original"))


@_query("q01_raw_events", _with(f"select {_EVENT}, k, original from u where account_id = 'acc_3' and timestamp_ms >= {JAN_8} and timestamp_ms < {JAN_22}"))
def q01(spark, sf_dir):
    return _flat(_raw(spark, sf_dir, accounts=("acc_3",), from_ms=JAN_8, to_ms=JAN_22))


@_query("q02_account_scan", _with(f"select {_EVENT}, k, original from u where account_id = 'acc_7'"))
def q02(spark, sf_dir):
    return _flat(_raw(spark, sf_dir, accounts=("acc_7",)))


@_query("q03_sum_by_meter", _with("select meter_id, cast(sum(quantity) as bigint) as quantity, count(*) as count from u where account_id = 'acc_3' group by 1"))
def q03(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT meter_id, SUM(quantity), COUNT(*) FROM usage_events WHERE account_id = 'acc_3' GROUP BY meter_id")


@_query("q04_in_filter", _with("select product_id, cast(sum(quantity) as bigint) as quantity from u where meter_id in ('click', 'purchase') and model_id in ('m1', 'm2') group by 1"))
def q04(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT product_id, SUM(quantity) FROM usage_events WHERE meter_id IN ('click', 'purchase') AND model_id IN ('m1', 'm2') GROUP BY product_id")


@_query("q05_range_bounds", _with(f"select account_id, cast(sum(quantity) as bigint) as quantity, count(*) as count from u where timestamp_ms > {JAN_8} and timestamp_ms <= {JAN_22} and timestamp_ms >= {JAN_1} and timestamp_ms < {FEB_1} group by 1"))
def q05(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT account_id, SUM(quantity), COUNT(*) FROM usage_events WHERE timestamp_ms > {JAN_8} AND timestamp_ms <= {JAN_22} AND timestamp_ms >= {JAN_1} AND timestamp_ms < {FEB_1}")


@_query("q06_kinds", _with("select kind, cast(sum(quantity) as bigint) as quantity, count(*) as count from u where kind in ('Correction', 'Retraction', 'Usage') group by 1"))
def q06(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT kind, SUM(quantity), COUNT(*) FROM usage_events WHERE kind IN ('Correction', 'Retraction', 'Usage') GROUP BY kind")


@_query("q07_dimension_filter", _with("select meter_id, cast(sum(quantity) as bigint) as quantity, count(*) as count from u where k = '42' group by 1"))
def q07(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT meter_id, SUM(quantity), COUNT(*) FROM usage_events WHERE k = 42 GROUP BY meter_id")


@_query("q08_global_totals", _with("select cast(sum(quantity) as bigint) as quantity, count(*) as count from u"))
def q08(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT SUM(quantity), COUNT(*) FROM usage_events")


@_query("q08_empty_range", "select cast(0 as bigint) as quantity, cast(0 as bigint) as count")
def q08_empty(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT SUM(quantity), COUNT(*) FROM usage_events WHERE timestamp_ms < 1000")


@_query("q09_distinct_groups", _with("select distinct account_id, coalesce(model_id, '') as model_id from u"))
def q09(spark, sf_dir):
    return _raw(spark, sf_dir, group_by=("account_id", "model_id"))


@_query("q10_hourly_rollup", _with("select account_id, subscription_id, product_id, meter_id, model_id, source, unit, hour_start_ms, k, cast(quantity_sum as bigint) as quantity_sum, event_count, first_event_ms, last_event_ms from r", _ROLLED))
def q10(spark, sf_dir):
    rolled = rollup.hourly_rollup(events_as_usage(spark, sf_dir))
    return _whole(rolled, "quantity_sum").withColumn("k", F.get_json_object("dimensions_canonical", "$.k")).drop("dimensions_canonical")


@_query("q11_stitched_usage", _with("select account_id, meter_id, cast(sum(quantity) as bigint) as quantity, count(*) as count, cast(sum(events) as bigint) as events from s group by 1, 2", _ROLLED, _STITCHED))
def q11(spark, sf_dir):
    return _whole(_sealed(spark, sf_dir, group_by=("account_id", "meter_id"), metrics=(*SUM_COUNT, ("events", Metric.EVENTS))))


@_query("q11_exact_edges", _with(f"select meter_id, cast(sum(quantity) as bigint) as quantity, count(*) as events from u where timestamp_ms >= {JAN_8 + 1234567} and timestamp_ms < {WATERMARK - 7654321} group by 1"))
def q11_edges(spark, sf_dir):
    return _whole(_sealed(spark, sf_dir, from_ms=JAN_8 + 1234567, to_ms=WATERMARK - 7654321, exact_edges=True, group_by=("meter_id",), metrics=(("quantity", Metric.SUM), ("events", Metric.EVENTS))))


@_query("q12_implicit_group_by", _with("select account_id, meter_id, source, cast(sum(quantity) as bigint) as quantity from u group by 1, 2, 3"))
def q12(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT account_id, SUM(quantity), meter_id FROM usage_events GROUP BY source")


@_query("q13_product_meter_model", _with("select product_id, meter_id, coalesce(model_id, '') as model_id, cast(sum(quantity) as bigint) as quantity, count(*) as count from u group by 1, 2, 3"))
def q13(spark, sf_dir):
    return _whole(_raw(spark, sf_dir, group_by=("product_id", "meter_id", "model_id"), metrics=SUM_COUNT))


@_query("q14_daily_from_rollups", _with(f"select cast({_DAY} as varchar) as day, account_id, cast(sum(quantity) as bigint) as quantity, cast(sum(events) as bigint) as events from s group by 1, 2", _ROLLED, _STITCHED))
def q14(spark, sf_dir):
    return _whole(_sealed(spark, sf_dir, group_by=("day", "account_id"), metrics=(("quantity", Metric.SUM), ("events", Metric.EVENTS))))


_stores: dict[tuple[str, str], UsageStore] = {}


def sealed_store(spark, sf_dir) -> UsageStore:
    """A store with all events, flushed, and sealed up to the watermark; made once a session in the folder that driver and executors share."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        shared = (spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()).removeprefix("file://").removeprefix("file:")
        store = UsageStore(spark, os.path.join(shared, f"usage-store-{uuid.uuid4().hex}"), flush_bytes=1 << 40)
        store.ingest(events_as_usage(spark, sf_dir))
        store.flush()
        store.tick(WATERMARK + store.safety_lag_ms)
        _stores[key] = store
    return _stores[key]


@_query("q70_stitched_from_store", _oracles["q11_stitched_usage"])
def q70(spark, sf_dir):
    return _whole(sealed_store(spark, sf_dir).query(QueryPlan(source=Source.ROLLUP, group_by=("account_id", "meter_id"), metrics=(*SUM_COUNT, ("events", Metric.EVENTS)))))


@_query("q71_daily_from_store", _oracles["q14_daily_from_rollups"])
def q71(spark, sf_dir):
    return _whole(sealed_store(spark, sf_dir).query(QueryPlan(source=Source.ROLLUP, group_by=("day", "account_id"), metrics=(("quantity", Metric.SUM), ("events", Metric.EVENTS)))))


@_query("q72_daily_raw_from_store", _with(f"select cast({_DAY} as varchar) as day, account_id, cast(sum(quantity) as bigint) as quantity from u group by 1, 2"))
def q72(spark, sf_dir):
    return _whole(sealed_store(spark, sf_dir).query(QueryPlan(group_by=("day", "account_id"), metrics=(("quantity", Metric.SUM),))))


@_query("q15_by_hour", _with(f"select cast({_HOUR} as varchar) as hour_start_ms, cast(sum(quantity) as bigint) as quantity, count(*) as count from u group by 1"))
def q15(spark, sf_dir):
    return _whole(_raw(spark, sf_dir, group_by=("hour_start_ms",), metrics=SUM_COUNT))


@_query("q16_by_dimension", _with("select coalesce(k, '') as k, '' as absent, cast(sum(quantity) as bigint) as quantity, count(*) as count from u group by 1"))
def q16(spark, sf_dir):
    return _whole(_raw(spark, sf_dir, group_by=("k", "absent"), metrics=SUM_COUNT))


@_query("q17_source_unit", _with("select source, unit, coalesce(subscription_id, '') as subscription_id, cast(sum(quantity) as bigint) as quantity, count(*) as count from u group by 1, 2, 3"))
def q17(spark, sf_dir):
    return _whole(_raw(spark, sf_dir, group_by=("source", "unit", "subscription_id"), metrics=SUM_COUNT))


@_query("q18_monthly_by_account", _with("select account_id, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m') as period, cast(sum(quantity) as bigint) as quantity, count(*) as count from u group by 1, 2"))
def q18(spark, sf_dir):
    rows = events_as_usage(spark, sf_dir).groupBy("account_id", period_of().alias("period")).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("count"))
    return _whole(rows)


def _spoilt(usage: DataFrame) -> DataFrame:
    """Events of which some break a rule, by their number."""
    n = F.substring("event_id", 5, 20).cast("long")
    many = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.struct(i.cast("string"), F.lit("x"))))
    return usage.select(
        n.alias("n"),
        F.when(n % 101 == 1, "").otherwise(F.col("event_id")).alias("event_id"),
        F.when(n % 103 == 2, "Other").otherwise(F.col("kind")).alias("kind"),
        F.when(n % 40 != 0, F.col("correction_ref")).alias("correction_ref"),
        F.when(n % 107 == 3, "").otherwise(F.col("account_id")).alias("account_id"),
        "subscription_id",
        F.when(n % 109 == 4, "").otherwise(F.col("product_id")).alias("product_id"),
        F.when(n % 113 == 5, "").otherwise(F.col("meter_id")).alias("meter_id"),
        F.when(n % 127 == 6, F.lit(0).cast("long")).otherwise(F.col("timestamp_ms")).alias("timestamp_ms"),
        "quantity", "unit", "source", "model_id",
        F.when(n % 131 == 7, many).otherwise(F.col("dimensions")).alias("dimensions"),
        "ingested_at_ms",
    )


_REASON = "case when n % 101 = 1 then 'event_id is empty' when n % 107 = 3 then 'account_id is empty' when n % 109 = 4 then 'product_id is empty' when n % 113 = 5 then 'meter_id is empty' when n % 127 = 6 then 'timestamp_ms must be positive' when n % 131 = 7 then 'too many dimensions' when n % 103 = 2 then 'unknown kind' when n % 40 = 0 then 'correction_ref is required' end"


@_query("q19_validation_reasons", _with(f"select n, {_REASON} as reject_reason from u"))
def q19(spark, sf_dir):
    return ingest.validate(_spoilt(events_as_usage(spark, sf_dir))).select("n", "reject_reason")


def _batch(usage: DataFrame) -> DataFrame:
    """A batch with each event once, then a tenth again, then one in seventeen with another quantity."""
    n = F.substring("event_id", 5, 20).cast("long")
    again = usage.where(n % 10 == 0).withColumn("batch_pos", n + 1_000_000_000)
    other = usage.where(n % 17 == 0).withColumn("quantity", (F.col("quantity") + 1).cast("decimal(38,0)")).withColumn("batch_pos", n + 2_000_000_000)
    return usage.withColumn("batch_pos", n).unionByName(again).unionByName(other)


_BATCH = "b as (select event_id, n as batch_pos, 'new' as status from u union all select event_id, n + 1000000000, 'duplicate' from u where n % 10 = 0 union all select event_id, n + 2000000000, 'conflict' from u where n % 17 = 0)"


@_query("q20_classify_batch", _with("select event_id, batch_pos, status from b", _BATCH))
def q20(spark, sf_dir):
    return ingest.classify(_batch(events_as_usage(spark, sf_dir))).select("event_id", "batch_pos", "status")


@_query("q21_closed_period_gate", _with("select event_id, case when kind = 'Usage' and n is not null and account_id in ('acc_3', 'acc_9') and strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m') = '2024-01' then 'period is closed' end as reject_reason from u"))
def q21(spark, sf_dir):
    closed = spark.createDataFrame([("acc_3", "2024-01"), ("acc_9", "2024-01"), ("acc_4", "2023-12")], "account_id string, period string")
    return ingest.gate_closed(events_as_usage(spark, sf_dir), closed).select("event_id", "reject_reason")


@_query("q22_classify_against_history", _with(f"select b.event_id, batch_pos, case when status = 'new' and u.timestamp_ms < {WATERMARK} then 'duplicate' else status end as status from b join u using (event_id)", _BATCH))
def q22(spark, sf_dir):
    usage = events_as_usage(spark, sf_dir)
    history = ingest.dedupe_index(usage.where(F.col("timestamp_ms") < WATERMARK))
    return ingest.classify(_batch(usage), history).select("event_id", "batch_pos", "status")


@_query("q22_dedupe_ttl", _with(f"select event_id, case when ingested_at_ms >= {WATERMARK - ingest.DEDUPE_TTL_MS} then 'duplicate' else 'new' end as status from u where timestamp_ms < {WATERMARK}"))
def q22_ttl(spark, sf_dir):
    usage = events_as_usage(spark, sf_dir).where(F.col("timestamp_ms") < WATERMARK)
    return ingest.classify(usage.withColumn("batch_pos", F.monotonically_increasing_id()), ingest.dedupe_index(usage), WATERMARK).select("event_id", "status")


@_query("q23_period_snapshot", _with(f"select account_id, cast(sum(quantity) as bigint) as quantity, count(*) as count, cast(sum(events) as bigint) as events from s where timestamp_ms >= {JAN_1} and timestamp_ms < {FEB_1} group by 1", _ROLLED, _STITCHED))
def q23(spark, sf_dir):
    return _whole(_sealed(spark, sf_dir, from_ms=JAN_1, to_ms=FEB_1, group_by=("account_id",), metrics=(*SUM_COUNT, ("events", Metric.EVENTS))))


@_query("q24_adjustments", _with(f"select count(*) as pending_adjustments, cast(coalesce(sum(quantity), 0) as bigint) as adjustments_quantity from u where account_id = 'acc_3' and kind <> 'Usage' and timestamp_ms >= {JAN_1} and timestamp_ms < {FEB_1} and ingested_at_ms > {JAN_8}"))
def q24(spark, sf_dir):
    rows = audit.adjustments(events_as_usage(spark, sf_dir), "acc_3", JAN_1, FEB_1, JAN_8)
    return _whole(rows.agg(F.count("*").alias("pending_adjustments"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("adjustments_quantity")), "adjustments_quantity")


@_query("q25_explain", _with(f"select product_id, meter_id, coalesce(model_id, '') as model_id, source, unit, cast(sum(quantity) as bigint) as quantity, count(*) as count from s where account_id = 'acc_3' and timestamp_ms >= {JAN_8} and timestamp_ms < {JAN_22} group by 1, 2, 3, 4, 5", _ROLLED, _STITCHED))
def q25(spark, sf_dir):
    raw = events_as_usage(spark, sf_dir).where("account_id = 'acc_3'")
    sealed = rollup.hourly_rollup(raw.where(F.col("timestamp_ms") < WATERMARK))
    return _whole(audit.explain_lines(stitch(raw, sealed, WATERMARK, JAN_8, JAN_22)))


@_query("q26_drift", _with(f"select cast(sum(quantity) as bigint) as raw_total, cast(sum(case when timestamp_ms >= {WATERMARK} or n % 33 <> 0 then quantity end) as bigint) as rollup_total, cast(sum(case when timestamp_ms < {WATERMARK} and n % 33 = 0 then quantity else 0 end) as bigint) as drift, sum(case when timestamp_ms < {WATERMARK} and n % 33 = 0 then quantity else 0 end) = 0 as matches, false as period_sealed from u"))
def q26(spark, sf_dir):
    raw = events_as_usage(spark, sf_dir)
    late = F.substring("event_id", 5, 20).cast("long") % 33 == 0
    sealed = rollup.hourly_rollup(raw.where((F.col("timestamp_ms") < WATERMARK) & ~late))
    return _whole(audit.drift(raw, sealed, JAN_1, FEB_1, WATERMARK), "raw_total", "rollup_total", "drift")


@_query("q27_rebuilt_rollup", _with(f"select account_id, hour_start_ms, cast(sum(quantity_sum) as bigint) as quantity_sum, cast(sum(event_count) as bigint) as event_count from r where hour_start_ms >= {JAN_8} and hour_start_ms < {WATERMARK} group by 1, 2", _ROLLED))
def q27(spark, sf_dir):
    raw = events_as_usage(spark, sf_dir).where((F.col("timestamp_ms") >= JAN_8) & (F.col("timestamp_ms") < WATERMARK))
    return _whole(rollup.hourly_rollup(raw).groupBy("account_id", "hour_start_ms").agg(F.sum("quantity_sum").alias("quantity_sum"), F.sum("event_count").alias("event_count")), "quantity_sum")


@_query("q28_compaction_dedupe", _with("select event_id, timestamp_ms, account_id from u"))
def q28(spark, sf_dir):
    usage = events_as_usage(spark, sf_dir)
    again = usage.where(F.substring("event_id", 5, 20).cast("long") % 10 == 0)
    return ingest.first_by_id(usage.unionByName(again)).select("event_id", "timestamp_ms", "account_id")


@_query("q28_conflicting_ids", _with("select event_id, cast(2 as bigint) as payloads from u where n % 17 = 0"))
def q28_conflicts(spark, sf_dir):
    return ingest.conflicting_ids(_batch(events_as_usage(spark, sf_dir)))


@_query("q30_canonical_order", _with("select account_id, product_id, meter_id, coalesce(model_id, '') as model_id, timestamp_ms, row_number() over (partition by account_id order by product_id, meter_id, coalesce(model_id, ''), timestamp_ms) as place from u"))
def q30(spark, sf_dir):
    """Where each row of an account stands in the order that segments are written in."""
    rows = rollup.in_canonical_order(rollup.with_bucket(events_as_usage(spark, sf_dir), 64)).withColumn("at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("account_id").orderBy("at")).cast("long")
    return rows.select("account_id", "product_id", "meter_id", F.coalesce("model_id", F.lit("")).alias("model_id"), "timestamp_ms", place.alias("place"))


@_query("q31_segment_statistics", _with("select account_id, count(*) as row_count, min(timestamp_ms) as min_timestamp_ms, max(timestamp_ms) as max_timestamp_ms, array_to_string(list_sort(list_distinct(list(product_id))), ',') as products, array_to_string(list_sort(list_distinct(list(meter_id))), ',') as meters, coalesce(array_to_string(list_sort(list_distinct(list(model_id) filter (model_id is not null))), ','), '') as models, cast(sum(quantity) as bigint) as quantity_sum from u group by 1"))
def q31(spark, sf_dir):
    stats = rollup.segment_statistics(events_as_usage(spark, sf_dir).withColumn("segment", F.col("account_id")), "segment")
    lists = {c: F.array_join(c, ",") for c in ("products", "meters", "models")}
    return _whole(stats.withColumns(lists), "quantity_sum").drop("min_account", "max_account").withColumnRenamed("segment", "account_id")


@_query("q32_bucket_counts", _with("select count(distinct account_id) as accounts, count(*) as events, cast(0 as bigint) as split_accounts, true as in_range, true as balanced from u"))
def q32(spark, sf_dir):
    """Every account is in one bucket of the 64, nothing is lost, and no bucket holds more than four times its share of accounts (and ten)."""
    by_account = events_as_usage(spark, sf_dir).groupBy("account_id", bucket_of(64).alias("bucket")).agg(F.count("*").alias("n"))
    per_account = by_account.groupBy("account_id").agg(F.count("*").alias("buckets"), F.sum("n").alias("n"))
    totals = per_account.agg(F.count("*").alias("accounts"), F.sum("n").alias("events"), F.count_if(F.col("buckets") > 1).alias("split_accounts"))
    sizes = by_account.groupBy("bucket").agg(F.count("*").alias("held")).agg(F.max("held").alias("most"), F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    joined = totals.join(F.broadcast(sizes))  # one row each
    return joined.select("accounts", "events", "split_accounts", ((F.col("low") >= 0) & (F.col("high") < 64)).alias("in_range"), (F.col("most") <= 10 + 4 * F.col("accounts") / 64).alias("balanced"))


@_query("q40_export", _with("select event_id, kind, original as correction_original_event_id, case when original is not null then 'derived' end as correction_reason, account_id, subscription_id, product_id, meter_id, model_id, timestamp_ms, quantity, unit, source, concat('{\"k\":\"', k, '\"}') as dimensions_canonical, ingested_at_ms from u"))
def q40(spark, sf_dir):
    return _whole(flat_events(events_as_usage(spark, sf_dir)))


@_query("q41_canonical_dimensions", _with("select distinct concat('{\"k\":\"', k, '\"}') as dimensions_canonical from u"))
def q41(spark, sf_dir):
    return events_as_usage(spark, sf_dir).select(canonical_dimensions().alias("dimensions_canonical")).distinct()


@_query("q42_orphan_corrections", _with("select event_id, kind, original as original_event_id from u where kind <> 'Usage' and original not in (select event_id from u)"))
def q42(spark, sf_dir):
    return audit.orphan_corrections(events_as_usage(spark, sf_dir))


@_query("q50_top_accounts", _with(f"select account_id, cast(sum(quantity) as bigint) as quantity from u where meter_id = 'purchase' and timestamp_ms >= {JAN_1} and timestamp_ms < {FEB_1} group by 1 order by 2 desc, 1 limit 100"))
def q50(spark, sf_dir):
    return _whole(audit.top_accounts(events_as_usage(spark, sf_dir), "purchase", JAN_1, FEB_1))


@_query("q60_order_line_usage", "select concat('cust_', o_custkey) as account_id, l_returnflag as product_id, l_linestatus as meter_id, cast(sum((case when l_returnflag = 'R' then -1 else 1 end) * cast(l_quantity as bigint)) as bigint) as quantity, count(*) as count from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3")
def q60(spark, sf_dir):
    plan = QueryPlan(group_by=("account_id", "product_id", "meter_id"), metrics=SUM_COUNT)
    return _whole(compile_plan(plan, lineitem_as_usage(spark, sf_dir)))


@_query("q61_filters_combined", _with("select account_id, source, cast(sum(quantity) as bigint) as quantity, count(*) as count from u where subscription_id in ('sub_1', 'sub_2', 'sub_3', 'sub_4') and unit = 'unit' and product_id = 'prod_1' and source = 'src_1' group by 1, 2"))
def q61(spark, sf_dir):
    filters = (Filter("subscription_id", ("sub_1", "sub_2", "sub_3", "sub_4")), Filter("unit", ("unit",)), Filter("product_id", ("prod_1",)), Filter("source", ("src_1",)))
    return _whole(_raw(spark, sf_dir, filters=filters, group_by=("account_id", "source"), metrics=SUM_COUNT))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship: usage by account and meter, sealed hours from rollups and the rest from raw events."""
    return q11(spark, sf_dir)


def queries() -> dict:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
