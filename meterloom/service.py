"""The store's API as Python calls and, if wanted, over HTTP (standard library only).

JSON leaves DataFrames only here: sums become text, group keys are text, and groups
come in the order of their keys.
"""

from __future__ import annotations

import json
import threading
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .periods import parse_period, parse_time
from .plans.query import MAX_MS, MIN_MS, Filter, Metric, QueryError, QueryPlan, Source
from .plans.sql import parse_sql
from .sources.usage import events_from_rows
from .store import UsageStore

_FILTER_NAMES = {"product": "product_id", "meter": "meter_id", "model": "model_id", "source": "source"}
_GROUP_NAMES = {"product": "product_id", "meter": "meter_id", "model": "model_id", "subscription": "subscription_id", "account": "account_id", "hour": "hour_start_ms"}


class Workers:
    """Background ticks of rollups and compaction over one service, until ``stop``."""

    def __init__(self, service: UsageService, tick_s: float = 30, compact_s: float = 60):
        self._stop = threading.Event()
        jobs = ((service.store.tick, tick_s), (service.store.compact, compact_s))
        self._threads = [threading.Thread(target=self._run, args=(service, f, s), daemon=True) for f, s in jobs]
        for t in self._threads:
            t.start()

    def _run(self, service, job, every_s):
        while not self._stop.wait(every_s):
            with service._write:
                job()

    def stop(self) -> None:
        self._stop.set()
        for t in self._threads:
            t.join()


def to_json(value):
    """Rows and nested values as JSON; decimals as text."""
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, dict):
        return {k: to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    return value


def _event(row) -> dict:
    out = row.asDict(recursive=True)
    return out | {"quantity": int(out["quantity"]), "dimensions": {"inner": out["dimensions"] or {}}}


class UsageService:
    """Validated requests against one store; calls that change it are serialised."""

    def __init__(self, store: UsageStore):
        self.store = store
        self._write = threading.Lock()

    def _lines(self, plan: QueryPlan) -> list[dict]:
        found = self.store.query(plan)
        if not plan.group_by and not plan.metrics:
            return [_event(r) for r in found.orderBy("timestamp_ms", "event_id").collect()]
        return [to_json(r.asDict()) for r in (found.orderBy(*plan.group_by) if plan.group_by else found).collect()]

    def ingest(self, events: list[dict], now_ms: int | None = None) -> dict:
        with self._write:
            return self.store.ingest(events_from_rows(self.store.spark, events), now_ms)

    def account_usage(self, account_id: str, from_ms: int, to_ms: int, group_by=(), source: str = "rollup", **filters) -> dict:
        unknown = set(filters) - set(_FILTER_NAMES)
        if unknown:
            raise QueryError(f"unknown filter {sorted(unknown)}")
        chosen = tuple(Filter(_FILTER_NAMES[k], (v,)) for k, v in filters.items() if v)
        keys = tuple(_GROUP_NAMES.get(k, k) for k in group_by)
        plan = QueryPlan(_source(source), from_ms, to_ms, (account_id,), chosen, keys, (("quantity", Metric.SUM), ("count", Metric.COUNT)))
        watermark = self.store.manifest.watermark_ms
        return {"watermark_ms": watermark, "lines": self._lines(plan)}

    def account_events(self, account_id: str, from_ms: int, to_ms: int, meter: str | None = None, product: str | None = None) -> dict:
        chosen = tuple(Filter(c, (v,)) for c, v in (("meter_id", meter), ("product_id", product)) if v)
        return {"events": self._lines(QueryPlan(Source.RAW, from_ms, to_ms, (account_id,), chosen))}

    def query_json(self, request: dict) -> dict:
        if not request.get("account_id"):
            raise QueryError("account_id is required")
        metrics = []
        for label, function in (request.get("metrics") or {}).items():
            try:
                metrics.append((label, Metric(str(function).lower())))
            except ValueError:
                raise QueryError(f"unknown metric {function!r}") from None
        filters = tuple(Filter(k, tuple(v if isinstance(v, list) else [v])) for k, v in (request.get("filters") or {}).items())
        bound = lambda v, default: default if v is None else parse_time(v) if isinstance(v, str) else int(v)
        plan = QueryPlan(_source(request.get("source") or "rollup"), bound(request.get("from"), MIN_MS), bound(request.get("to"), MAX_MS), (request["account_id"],), filters, tuple(request.get("group_by") or ()), tuple(metrics))
        return {"data": self._lines(plan)}

    def query_sql(self, text: str) -> dict:
        return {"data": self._lines(parse_sql(text))}

    def explain(self, account_id: str, from_ms: int, to_ms: int) -> dict:
        found = self.store.explain(account_id, from_ms, to_ms)
        return to_json(found | {"corrections": [c | {"quantity": int(c["quantity"])} for c in found["corrections"]]})

    def verify(self, account_id: str, from_ms: int, to_ms: int) -> dict:
        return to_json(self.store.verify(account_id, from_ms, to_ms))

    def close_period(self, account_id: str, period: str) -> dict:
        with self._write:
            return self.store.close_period(account_id, *parse_period(period))

    def reopen_period(self, account_id: str, period: str) -> dict:
        with self._write:
            return self.store.reopen_period(account_id, *parse_period(period))

    def get_period(self, account_id: str, period: str) -> dict:
        return self.store.get_period(account_id, *parse_period(period))


def _source(name: str) -> Source:
    named = {"raw": Source.RAW, "usage_events": Source.RAW, "rollup": Source.ROLLUP, "usage_rollup_hourly": Source.ROLLUP}
    if name not in named:
        raise QueryError(f"unknown source {name!r}")
    return named[name]


def route(service: UsageService, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
    """Status and JSON value (text for health) of a request."""
    url = urlsplit(target)
    path = [unquote(p) for p in url.path.strip("/").split("/")]
    args = {k: v[0] for k, v in parse_qs(url.query).items()}
    span = lambda: (parse_time(args["from"]), parse_time(args["to"]))
    try:
        data = json.loads(body) if body else {}
        match (method, *path):
            case ("GET", "health"):
                return 200, "OK"
            case ("POST", "v1", "usage", "batch"):
                return 200, service.ingest(data["events"] if isinstance(data, dict) else data)
            case ("POST", "v1", "query", "json"):
                return 200, service.query_json(data)
            case ("POST", "v1", "query", "sql"):
                return 200, service.query_sql(data.get("sql") or data["query"])
            case ("GET", "v1", "accounts", account, "usage"):
                groups = [g for g in args.get("group_by", "").split(",") if g]
                return 200, service.account_usage(account, *span(), groups, **{k: args[k] for k in _FILTER_NAMES if k in args})
            case ("GET", "v1", "accounts", account, "usage", "events"):
                return 200, service.account_events(account, *span(), args.get("meter"), args.get("product"))
            case ("GET", "v1", "accounts", account, "explain"):
                return 200, service.explain(account, *span())
            case ("GET", "v1", "accounts", account, "verify"):
                return 200, service.verify(account, *span())
            case ("POST", "v1", "accounts", account, "periods", period, "close"):
                return 200, service.close_period(account, period)
            case ("POST", "v1", "accounts", account, "periods", period, "reopen"):
                return 200, service.reopen_period(account, period)
            case ("GET", "v1", "accounts", account, "periods", period):
                return 200, service.get_period(account, period)
        return 404, {"error": "not found"}
    except Exception as error:  # noqa: BLE001  every handler error is a 500, as callers expect
        return 500, f"Internal server error: {error}"


def serve(service: UsageService, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that isn't started yet: call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self):
            length = int(self.headers.get("Content-Length") or 0)
            status, value = route(service, self.command, self.path, self.rfile.read(length))
            raw = value.encode() if isinstance(value, str) else json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(value, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
