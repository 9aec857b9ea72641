import pytest

from meterloom.plans.query import MAX_MS, MIN_MS, Filter, Metric, QueryError, Source
from meterloom.plans.sql import parse_sql


def test_full_query():
    plan = parse_sql("select meter_id, sum(quantity), COUNT(*) FROM usage_events WHERE account_id = 'a''b' AND region IN ('eu', 'us') AND tier = 3 AND timestamp_ms >= 10 AND timestamp_ms < 20 GROUP BY meter_id, day;")
    assert plan.source is Source.RAW
    assert plan.accounts == ("a'b",)
    assert plan.filters == (Filter("region", ("eu", "us")), Filter("tier", ("3",)))
    assert (plan.from_ms, plan.to_ms) == (10, 20)
    assert plan.group_by == ("meter_id", "day")
    assert plan.metrics == (("quantity", Metric.SUM), ("count", Metric.COUNT))


@pytest.mark.parametrize(
    "where, low, high",
    [("timestamp_ms > 5", 6, MAX_MS), ("timestamp_ms >= 5", 5, MAX_MS), ("timestamp_ms < 5", MIN_MS, 5), ("timestamp_ms <= 5", MIN_MS, 6), ("hour_start_ms >= 3 AND timestamp_ms >= 7 AND timestamp_ms < 20 AND hour_start_ms < 11", 7, 11)],
)
def test_ranges_are_half_open_and_intersect(where, low, high):
    plan = parse_sql(f"SELECT COUNT(*) FROM usage_rollup_hourly WHERE {where}")
    assert (plan.from_ms, plan.to_ms, plan.source) == (low, high, Source.ROLLUP)


def test_repeated_accounts_intersect():
    assert parse_sql("SELECT COUNT(*) FROM usage_events WHERE account_id = 'a' AND account_id = 'b'").accounts == ()
    assert parse_sql("SELECT COUNT(*) FROM usage_events WHERE account_id IN ('a', 'b') AND account_id = 'b'").accounts == ("b",)


@pytest.mark.parametrize(
    "sql, why",
    [
        ("", "expected exactly one statement"),
        ("SELECT COUNT(*) FROM usage_events; SELECT COUNT(*) FROM usage_events", "expected exactly one statement"),
        ("DELETE FROM usage_events", "only SELECT statements are supported"),
        ("SELECT COUNT(*) FROM usage_events ORDER BY day", "ORDER BY is not supported"),
        ("WITH x AS (SELECT 1) SELECT COUNT(*) FROM usage_events", "WITH/CTE is not supported"),
        ("SELECT COUNT(*) FROM usage_events UNION SELECT COUNT(*) FROM usage_events", "compound queries (UNION/INTERSECT/EXCEPT) are not supported"),
        ("SELECT DISTINCT meter_id FROM usage_events", "SELECT DISTINCT is not supported"),
        ("SELECT COUNT(*) FROM usage_events WINDOW w AS (PARTITION BY day)", "WINDOW clauses are not supported"),
        ("SELECT COUNT(*) FROM usage_events GROUP BY day HAVING COUNT(*) > 1", "HAVING is not supported"),
        ("SELECT COUNT(*) FROM usage_events QUALIFY 1", "QUALIFY is not supported"),
        ("SELECT COUNT(*) FROM usage_events SORT BY day", "CLUSTER BY / DISTRIBUTE BY / SORT BY are not supported"),
        ("SELECT COUNT(*)", "exactly one FROM table is required"),
        ("SELECT COUNT(*) FROM usage_events, usage_events", "exactly one FROM table is required"),
        ("SELECT COUNT(*) FROM usage_events JOIN usage_rollup_hourly ON 1", "JOINs are not supported"),
        ("SELECT COUNT(*) FROM (SELECT 1)", "FROM must reference a simple table"),
        ("SELECT COUNT(*) FROM usage_events u", "table aliases are not supported"),
        ("SELECT COUNT(*) FROM usage_events AS u", "table aliases are not supported"),
        ("SELECT COUNT(*) FROM usage_events(1)", "table-valued function syntax is not supported"),
        ("SELECT COUNT(*) FROM usage_events FOR SYSTEM_TIME AS OF 1", "AS OF / table version qualifiers are not supported"),
        ("SELECT COUNT(*) FROM other", "unknown table `other`"),
        ("SELECT COUNT(*) FROM USAGE_EVENTS", "unknown table"),
        ("SELECT quantity + 1 FROM usage_events", "unsupported projection expression"),
        ("SELECT 1 FROM usage_events", "unsupported projection expression"),
        ("SELECT meter_id AS m FROM usage_events", "column aliases (AS) are not supported"),
        ("SELECT * FROM usage_events", "SELECT * is not supported"),
        ("SELECT usage_events.* FROM usage_events", "qualified wildcards (table.*) are not supported"),
        ("SELECT COUNT(*) FROM usage_events GROUP BY ROLLUP(day)", "GROUP BY modifiers (ROLLUP/CUBE/etc) are not supported"),
        ("SELECT COUNT(*) FROM usage_events GROUP BY day + 1", "unsupported GROUP BY expression"),
        ("SELECT COUNT(*) FROM usage_events GROUP BY ALL", "GROUP BY ALL is not supported"),
        ("SELECT COUNT(*) FROM usage_events LIMIT 5", "LIMIT is not supported in this build"),
        ("SELECT SUM(DISTINCT quantity) FROM usage_events", "DISTINCT/ALL not supported"),
        ("SELECT SUM(timestamp_ms) FROM usage_events", "SUM only supports the `quantity` column"),
        ("SELECT COUNT(quantity) FROM usage_events", "COUNT only supports COUNT(*)"),
        ("SELECT AVG(quantity) FROM usage_events", "unsupported aggregate function"),
        ("SELECT SUM(quantity) OVER () FROM usage_events", "OVER on an aggregate is not supported"),
        ("SELECT SUM(quantity) FILTER (WHERE day = 1) FROM usage_events", "FILTER on an aggregate is not supported"),
        ("SELECT COUNT(*) FROM usage_events WHERE meter_id = 'a' OR meter_id = 'b'", "OR in WHERE is not supported"),
        ("SELECT COUNT(*) FROM usage_events WHERE meter_id <> 'a'", "unsupported operator `<>` in WHERE"),
        ("SELECT COUNT(*) FROM usage_events WHERE 'a' IN ('a')", "IN: left side must be a column name"),
        ("SELECT COUNT(*) FROM usage_events WHERE meter_id NOT IN ('a')", "NOT IN is not supported"),
        ("SELECT COUNT(*) FROM usage_events WHERE meter_id LIKE 'a'", "unsupported WHERE expression"),
        ("SELECT COUNT(*) FROM usage_events WHERE meter_id IS NULL", "unsupported WHERE expression"),
        ("SELECT COUNT(*) FROM usage_events WHERE (meter_id = 'a')", "unsupported WHERE expression"),
        ("SELECT COUNT(*) FROM usage_events WHERE quantity > 5", "range comparison only supported on timestamp_ms / hour_start_ms"),
        ("SELECT COUNT(*) FROM usage_events WHERE timestamp_ms > 'x'", "range comparison value must parse as i64"),
        ("SELECT COUNT(*) FROM usage_events WHERE timestamp_ms > 99999999999999999999", "range comparison value must parse as i64"),
        ("SELECT COUNT(*) FROM usage_events WHERE meter_id = -1", "unsupported literal"),
        ("SELECT COUNT(*) FROM usage_events WHERE meter_id = product_id", "expected a literal"),
        ("SELECT COUNT(*) FROM usage_events WHERE event_id = 'x'", "equality on `event_id` is not supported"),
    ],
)
def test_rejected(sql, why):
    with pytest.raises(QueryError) as error:
        parse_sql(sql)
    assert why in str(error.value)
