import json
import threading
import urllib.request

import pytest

from meterloom.service import UsageService, route, serve
from meterloom.store import UsageStore
from meterloom.streaming.ingest import ingest_stream, live_hourly_usage, read_json_stream

from .test_store import T0, event

SPAN = "from=2026-05-01T00:00:00Z&to=2026-06-01T00:00:00Z"


@pytest.fixture
def service(spark, tmp_path):
    store = UsageStore(spark, str(tmp_path / "db"), buckets=2)
    yield UsageService(store)
    store.catalog.close()


def ask(service, method, path, body=None):
    return route(service, method, path, json.dumps(body).encode() if body is not None else b"")


def test_routes(service):
    assert ask(service, "GET", "/health") == (200, "OK")
    batch = [event("e1", 5, dimensions={"inner": {"region": "eu"}}), event("e2", 7, model_id="m1"), event("c", -2, kind="Correction")]
    assert ask(service, "POST", "/v1/usage/batch", {"events": batch}) == (200, {"accepted": 3, "duplicates": 0, "conflicts": 0, "rejected": 0})
    assert ask(service, "GET", f"/v1/accounts/a/usage?{SPAN}&group_by=model")[1]["lines"] == [{"model_id": "", "quantity": "3", "count": 2}, {"model_id": "m1", "quantity": "7", "count": 1}]
    assert [e["quantity"] for e in ask(service, "GET", f"/v1/accounts/a/usage/events?{SPAN}")[1]["events"]] == [-2, 5, 7]
    assert ask(service, "POST", "/v1/query/sql", {"sql": "SELECT SUM(quantity) FROM usage_events WHERE region = 'eu'"})[1] == {"data": [{"quantity": "5"}]}
    assert ask(service, "POST", "/v1/query/json", {"account_id": "a", "source": "usage_events", "metrics": {"q": "sum"}})[1] == {"data": [{"q": "10"}]}
    assert ask(service, "GET", f"/v1/accounts/a/verify?{SPAN}")[1]["drift"] == "0"
    assert ask(service, "GET", f"/v1/accounts/a/explain?{SPAN}")[1]["corrections"][0]["event_id"] == "c"
    assert ask(service, "POST", "/v1/accounts/a/periods/2026-05/close")[1]["frozen"]["quantity"] == "10"
    assert ask(service, "GET", "/v1/accounts/a/periods/2026-05")[1]["net_total"] == "10"
    assert ask(service, "POST", "/v1/accounts/a/periods/2026-05/reopen")[1]["removed"] is True


@pytest.mark.parametrize(
    "method, path, body",
    [("GET", "/v1/accounts/a/usage?from=x&to=y", None), ("POST", "/v1/query/sql", {"sql": "SELECT * FROM usage_events"}), ("POST", "/v1/query/json", {}), ("POST", "/v1/query/json", {"account_id": "a", "metrics": {"q": "avg"}}), ("POST", "/v1/query/json", {"account_id": "a", "source": "x"}), ("GET", "/v1/accounts/a/periods/2026-99", None)],
)
def test_errors_are_500(service, method, path, body):
    status, said = ask(service, method, path, body)
    assert status == 500 and said.startswith("Internal server error: ")


def test_unknown_route(service):
    assert ask(service, "GET", "/nothing")[0] == 404


def test_http(service):
    server = serve(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as answer:
        assert answer.read() == b"OK"
    server.shutdown()
    server.server_close()


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [event("s1", 5, ingested_at_ms=1), event("s1", 5, ingested_at_ms=1), event("s2", 7, ingested_at_ms=1)]
    (folder / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    store, told = UsageStore(spark, str(tmp_path / "db"), buckets=2), []
    stream = read_json_stream(spark, str(folder))
    ingest_stream(stream, store, str(tmp_path / "ck"), lambda i, c: told.append(c)).awaitTermination(120)
    assert sum(c["accepted"] for c in told) == 2 and sum(c["duplicates"] for c in told) == 1
    (folder / "b.json").write_text(json.dumps(event("s2", 7, ingested_at_ms=2)) + "\n")
    ingest_stream(stream, store, str(tmp_path / "ck"), lambda i, c: told.append(c)).awaitTermination(120)
    assert sum(c["accepted"] for c in told) == 2 and sum(c["duplicates"] for c in told) == 2
    store.close()
    query = live_hourly_usage(stream).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.account_id, r.hour_start_ms, int(r.quantity)) for r in spark.table("live").collect()} == {("a", T0, 24)}


