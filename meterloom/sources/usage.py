"""Usage events from tables and files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_COLUMNS, RAW_SCHEMA


def events_as_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table in the shape of usage events; what it lacks is derived from its ids."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(
        "concat('evt_', cast(event_id as string)) as event_id",
        "case when event_id % 20 = 0 then 'Correction' when event_id % 50 = 7 then 'Retraction' else 'Usage' end as kind",
        "case when event_id % 20 = 0 or event_id % 50 = 7 then named_struct('original_event_id', concat('evt_', cast(event_id - 1 as string)), 'reason', 'derived') end as correction_ref",
        "concat('acc_', cast(user_id as string)) as account_id",
        "case when user_id % 5 = 0 then null else concat('sub_', cast(user_id as string)) end as subscription_id",
        "concat('prod_', cast(event_id % 3 as string)) as product_id",
        "event_type as meter_id",
        "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) as timestamp_ms",
        "cast((case when event_id % 20 = 0 or event_id % 50 = 7 then -1 else 1 end) * cast(round(value * 100) as bigint) as decimal(38,0)) as quantity",
        "'unit' as unit",
        "concat('src_', cast(event_id % 2 as string)) as source",
        "case when event_id % 7 = 0 then null else concat('m', cast(event_id % 4 as string)) end as model_id",
        "from_json(props, 'map<string,string>') as dimensions",
        "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) + 5 as ingested_at_ms",
    )


def lineitem_as_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as usage events: account is the customer, product the return flag, meter the line status; returns are retractions."""
    lines, orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as event_id",
        "case when l_returnflag = 'R' then 'Retraction' else 'Usage' end as kind",
        "case when l_returnflag = 'R' then named_struct('original_event_id', cast(l_orderkey as string), 'reason', 'returned') end as correction_ref",
        "concat('cust_', cast(o_custkey as string)) as account_id",
        "cast(null as string) as subscription_id",
        "l_returnflag as product_id",
        "l_linestatus as meter_id",
        "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) as timestamp_ms",
        "cast((case when l_returnflag = 'R' then -1 else 1 end) * cast(l_quantity as bigint) as decimal(38,0)) as quantity",
        "'piece' as unit",
        "'orders' as source",
        "cast(null as string) as model_id",
        "map('priority', o_orderpriority) as dimensions",
        "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate) + 5 as ingested_at_ms",
    )


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; lines that can't be read are dropped, as in a replay. Dimensions may be flat or ``{"inner": {...}}``."""
    raw = spark.read.schema(_ddl()).option("mode", "DROPMALFORMED").json(path)
    return normalise_dimensions(raw.where("event_id is not null"))


def _ddl() -> str:
    return ", ".join(f"{f.name} {'string' if f.name == 'dimensions' else f.dataType.simpleString()}" for f in RAW_SCHEMA)


def normalise_dimensions(raw: DataFrame) -> DataFrame:
    """Dimensions given as JSON text, flat or under ``inner``, become a map (empty if missing)."""
    nested = F.from_json(F.get_json_object("dimensions", "$.inner"), "map<string,string>")
    flat = F.from_json("dimensions", "map<string,string>")
    inner = F.get_json_object("dimensions", "$.inner").startswith("{")
    dims = F.when(F.coalesce(inner, F.lit(False)), nested).otherwise(F.coalesce(flat, F.create_map().cast("map<string,string>")))
    return raw.withColumn("dimensions", dims).select(*RAW_COLUMNS)


def events_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Events of Python mappings, with ``batch_pos`` in their order."""
    out = []
    for pos, row in enumerate(rows):
        ref, dims = row.get("correction_ref"), row.get("dimensions") or {}
        dims = dims["inner"] if isinstance(dims.get("inner"), dict) else dims
        quantity = row.get("quantity")
        if quantity is not None and abs(int(quantity)) >= 10**38:
            raise ValueError(f"quantity of {row.get('event_id')!r} has more than 38 digits")
        values = {**{c: row.get(c) for c in RAW_COLUMNS}, "dimensions": {str(k): str(v) for k, v in dims.items()}, "quantity": None if quantity is None else Decimal(int(quantity)), "correction_ref": (ref.get("original_event_id"), ref.get("reason")) if ref else None}
        out.append((*[values[c] for c in RAW_COLUMNS], pos))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMA) + ", batch_pos long"
    return spark.createDataFrame(out, ddl)
