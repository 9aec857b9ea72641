import json
import os
import random

import pytest

from meterloom.catalog import Catalog, CatalogError
from meterloom.periods import format_time, parse_period, parse_time, period_bounds
from meterloom.plans.query import Metric, QueryError, QueryPlan, Source
from meterloom.schema import HOUR_MS
from meterloom.sources.usage import events_from_rows
from meterloom.store import UsageStore

T0 = 1_777_593_600_000  # 2026-05-01T00:00Z
LATER = T0 + 40 * 86_400_000


def event(event_id, quantity=1, ts=T0, account="a", kind="Usage", **more):
    base = {"event_id": event_id, "kind": kind, "account_id": account, "product_id": "p", "meter_id": "m", "timestamp_ms": ts, "quantity": quantity, "unit": "u", "source": "s", "dimensions": {}}
    if kind != "Usage":
        base["correction_ref"] = {"original_event_id": "e", "reason": "r"}
    return base | more


@pytest.fixture
def store(spark, tmp_path):
    held = UsageStore(spark, str(tmp_path / "db"), buckets=4, compaction_trigger=2)
    yield held
    held.catalog.close()


def put(store, *events, now=LATER):
    return store.ingest(events_from_rows(store.spark, list(events)), now)


def total(store, source=Source.RAW, low=0, high=LATER, account="a"):
    return int(store.query(QueryPlan(source, low, high, (account,), (), (), (("quantity", Metric.SUM),))).first()[0])


def test_ingest_classifies_and_survives_a_restart(store, spark):
    assert put(store, event("e1"), event("e1"), event("e1", 5), event("e2"), event("", 1)) == {"accepted": 2, "duplicates": 1, "conflicts": 1, "rejected": 1}
    assert put(store, event("e2"), event("e2", 7), event("e3")) == {"accepted": 1, "duplicates": 1, "conflicts": 1, "rejected": 0}
    assert total(store) == 3 and store.conflicts().count() == 2
    store.catalog.close()
    again = UsageStore(spark, store.root, buckets=4)
    assert total(again) == 3
    assert again.flush() == 1 and total(again) == 3 and again.manifest.quantity() == 3
    assert put(again, event("e1"))["duplicates"] == 1
    again.catalog.close()
    store.catalog = Catalog(store.root)


def test_boundary_event_is_counted_once(store):
    put(store, event("b", 42, 1000))
    assert total(store, low=0, high=1000) == 0 and total(store, low=1000, high=2000) == 42


def test_rollups_stitch_to_the_raw_tail_and_show_drift(store):
    put(store, *[event(f"x{i}", 4, T0 + i) for i in range(5)], *[event(f"y{i}", 8, T0 + HOUR_MS + i) for i in range(5)])
    store.flush()
    assert store.tick(T0 + HOUR_MS + 60_000) == 1 and store.manifest.watermark_ms == T0 + HOUR_MS
    assert total(store, Source.ROLLUP) == 60 == total(store)
    assert store.tick(T0 + HOUR_MS + 60_000) == 0
    put(store, event("late", 50, T0 + 7))
    store.flush()
    found = store.verify("a", T0, T0 + HOUR_MS)
    assert (found["raw_total"], found["rollup_total"], found["drift"], found["matches"], found["period_sealed"]) == (70, 20, 50, False, True)
    store.rebuild_rollups(T0 + 5, T0 + HOUR_MS)
    assert store.manifest.watermark_ms == T0
    store.tick(T0 + 3 * HOUR_MS)
    assert store.verify("a", T0, T0 + 2 * HOUR_MS)["drift"] == 0
    lines = store.explain("a", T0, T0 + 2 * HOUR_MS)
    assert sum(r["quantity"] for r in lines["lines"]) == 110
    assert all(lines["rollup_inputs"][s] for s in lines["rollup_segments"])


def test_rebuilding_one_hour_keeps_the_others(store):
    put(store, *[event(f"h{i}", 1, T0 + i * HOUR_MS) for i in range(4)])
    store.flush()
    assert store.tick(T0 + 5 * HOUR_MS) == 4
    put(store, event("late", 10, T0 + HOUR_MS + 1))
    store.flush()
    assert store.rebuild_rollups(T0 + HOUR_MS, T0 + 2 * HOUR_MS) == 1
    assert total(store, Source.ROLLUP) == 14
    store.tick(T0 + 5 * HOUR_MS)
    assert total(store, Source.ROLLUP) == 14 == total(store)


def test_a_tick_waits_for_staged_events_and_for_data(store):
    assert store.tick(LATER) == 0 and store.manifest.watermark_ms == 0
    put(store, event("f", 1, T0))
    store.flush()
    put(store, event("s", 1, T0 + 30 * 60_000), now=LATER)
    assert store.tick(LATER + 1) == 0
    store.tick(LATER + 60_000)  # too old: flushed first
    assert total(store, Source.ROLLUP) == 2 and not store._staged_paths()


def test_corrections_net_and_kind_is_refused_on_rollups(store):
    put(store, event("u", 100), event("c", -40, kind="Correction"))
    assert total(store) == 60
    rows = {r.kind: int(r.quantity) for r in store.sql("SELECT kind, SUM(quantity) FROM usage_events").collect()}
    assert rows == {"Usage": 100, "Correction": -40}
    with pytest.raises(QueryError):
        store.sql("SELECT kind, SUM(quantity) FROM usage_rollup_hourly")


def test_periods(store):
    put(store, event("u1", 50), event("u2", 75, T0 + HOUR_MS), event("c0", -5, kind="Correction"), now=LATER)
    closed = store.close_period("a", 2026, 5, LATER + 10)
    assert closed["frozen"] == {"quantity": "120", "event_count": 3, "exact_event_count": 3}
    assert store.close_period("a", 2026, 5)["already_closed"]
    assert put(store, event("u3", 1), event("c1", -40, kind="Correction"), event("o", 1, account="b"), now=LATER + 20) == {"accepted": 2, "duplicates": 0, "conflicts": 0, "rejected": 1}
    found = store.get_period("a", 2026, 5)
    assert (found["pending_adjustments"], found["adjustments_quantity"], found["net_total"]) == (1, "-40", "80")
    assert store.reopen_period("a", 2026, 5)["removed"] and not store.reopen_period("a", 2026, 5)["removed"]
    assert put(store, event("u3", 1))["accepted"] == 1
    assert store.get_period("a", 2026, 5)["total_quantity"] == "81"


def test_closing_counts_late_events(store):
    put(store, event("u1", 10))
    store.flush()
    store.tick(LATER)
    put(store, event("late", 5, T0 + 1))
    assert store.close_period("a", 2026, 5, LATER + 10)["frozen"]["quantity"] == "15"


def test_compaction_changes_no_answer(store):
    for i in range(4):
        put(store, event(f"k{i}", 2, T0 + i), event(f"z{i}", 3, account="b"))
        store.flush()
    before = total(store), total(store, account="b"), store.published_events().count()
    done = store.compact(LATER)
    assert done["compacted"] >= 1 and (total(store), total(store, account="b"), store.published_events().count()) == before
    held = [p for r in store.manifest.replaced for p in r.paths]
    assert held and all(os.path.isdir(p) for p in held)
    assert store.compact(LATER + 1)["removed"] == 0 and store.compact(LATER + 30_000)["removed"] >= 1
    assert not any(os.path.isdir(p) for p in held) and total(store) == before[0]
    assert store.check(deep=True)["failed"] == []


def test_admin_and_export(store, spark, tmp_path, capsys):
    import io

    from meterloom.admin import main

    put(store, event("u1", 10, dimensions={"b": "2", "a": "1"}), event("r", -1, kind="Retraction"))
    store.flush()
    segment = store.manifest.segments[0].segment_id
    store.catalog.close()

    def run(*args):
        out = io.StringIO()
        assert main(["--db-root", store.root, *args], spark, out) == 0
        return json.loads(out.getvalue())

    assert run("check", "--deep")["rows"] == 2
    assert run("inspect-segment", segment)["meta"]["row_count"] == 2
    assert run("verify-period", "--account", "a", "--from", "2026-05-01T00:00:00Z", "--to", "2026-06-01T00:00:00Z")["matches"]
    assert run("export-parquet", str(tmp_path / "x"), "--single-file")["rows"] == 2
    flat = spark.read.parquet(str(tmp_path / "x"))
    assert len(flat.columns) == 15 and {r.dimensions_canonical for r in flat.collect()} == {'{"a":"1","b":"2"}', "{}"}
    assert main(["--db-root", store.root, "inspect-segment", "none"], spark) == 1
    store.catalog = Catalog(store.root)


def test_catalogue_generations(tmp_path):
    held = Catalog(str(tmp_path))
    with pytest.raises(CatalogError):
        Catalog(str(tmp_path))
    for i in range(14):
        held.commit(watermark_ms=i)
    files = [f for f in os.listdir(held.folder) if f.startswith("manifest-")]
    assert len(files) == 10
    assert held.rollback(8).watermark_ms == 7
    newest = held._file(held.manifest.generation)
    held.close()
    with open(newest, "w") as f:
        f.write("{")
    again = Catalog(str(tmp_path))
    assert again.manifest.watermark_ms == 13
    assert again.commit(watermark_ms=99).generation > 15
    again.close()
    for f in os.listdir(again.folder):
        if f.startswith("manifest-"):
            with open(os.path.join(again.folder, f), "w") as out:
                out.write("no")
    with pytest.raises(CatalogError):
        Catalog(str(tmp_path))


def test_time_and_period_texts():
    assert parse_period("2026-12") == (2026, 12)
    assert period_bounds(2026, 12) == (parse_time("2026-12-01T00:00:00Z"), parse_time("2027-01-01T00:00:00Z"))
    assert format_time(T0) == "2026-05-01T00:00:00Z" and parse_time("2026-05-01T02:00:00.005+02:00") == T0 + 5
    for bad in ("2026-13", "26-01", "2026-1"):
        with pytest.raises(ValueError):
            parse_period(bad)
    for bad in ("yesterday", "2026-05-01T00:00:00"):
        with pytest.raises(ValueError):
            parse_time(bad)


def test_random_operations_against_a_model(spark, tmp_path):
    """Ingest, flush, tick, compact, rebuild and restart in any order: raw and rollup answers are the model's."""
    dice = random.Random(7)
    store = UsageStore(spark, str(tmp_path / "db"), buckets=2, compaction_trigger=1)
    model: dict[str, tuple[str, int]] = {}
    now = T0 + 10 * HOUR_MS
    for step in range(10):
        op = dice.choice(["ingest", "ingest", "flush", "tick", "compact", "restart", "rebuild"])
        if op == "ingest":
            rows = [event(f"{dice.choice('abcdef')}{dice.randint(0, 2)}", dice.randint(1, 9), T0 + dice.randint(0, 4 * HOUR_MS), dice.choice("ab")) for _ in range(4)]
            put(store, *rows, now=now)
            for r in rows:
                model.setdefault(r["event_id"], (r["account_id"], r["quantity"]))
        elif op == "restart":
            store.catalog.close()
            store = UsageStore(spark, store.root, buckets=2, compaction_trigger=1)
        elif op == "rebuild":
            store.rebuild_rollups(T0, T0 + 5 * HOUR_MS)
        else:
            {"flush": store.flush, "tick": lambda: store.tick(now), "compact": lambda: store.compact(now)}[op]()
    for account in "ab":
        expected = sum(q for a, q in model.values() if a == account)
        assert total(store, account=account) == expected
    store.flush()
    store.rebuild_rollups(T0, T0 + 5 * HOUR_MS)
    store.tick(now)
    for account in "ab":
        assert total(store, Source.ROLLUP, account=account) == sum(q for a, q in model.values() if a == account)
    store.catalog.close()


def test_ids_that_stand_alone_are_not_shuffled_for_classification(store, spark, monkeypatch):
    from meterloom.operators import ingest

    seen = []
    classify = ingest.classify
    monkeypatch.setattr(ingest, "classify", lambda batch, *more: seen.append(sorted(r.event_id for r in batch.collect())) or classify(batch, *more))
    assert put(store, *[event(f"e{k}") for k in range(20)], event("e3"), event("e4", 9)) == {"accepted": 20, "duplicates": 1, "conflicts": 1, "rejected": 0}
    assert put(store, event("e5"), event("e6", 2), event("n1"), event("n2")) == {"accepted": 2, "duplicates": 1, "conflicts": 1, "rejected": 0}
    assert seen == [["e3", "e3", "e4", "e4"], ["e5", "e6"]] and total(store) == 22
    monkeypatch.setattr(ingest, "FEW_IDS", 0)
    assert put(store, event("n2"), event("n3"))["accepted"] == 1 and seen[-1] == ["n2", "n3"]
