"""The usage store: idempotent ingest, segments under a manifest, rollups, compaction, periods and queries.

State changes are computed by Spark and published by one manifest commit; the
driver holds only metadata.  A query works on the manifest that it began with.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, ClosedPeriod, DedupeIndex, Manifest, Replacement, SegmentMeta, prune
from .functions.expressions import bucket_of, payload_hash
from .operators import audit, ingest, rollup
from .periods import period_bounds
from .plans.compiler import compile_plan, in_range, stitch
from .plans.query import MAX_MS, MIN_MS, Metric, QueryPlan, Source
from .plans.sql import parse_sql
from .schema import HOUR_MS, RAW_COLUMNS, RAW_SCHEMA, ROLLUP_SCHEMA

_ROLLUP = ROLLUP_SCHEMA.fieldNames()
_INDEX = "event_id string, payload_hash string, ingested_at_ms long"


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


class UsageStore:
    """A store in a folder that driver and executors share.

    Accepted batches are staged and visible at once; ``flush`` turns what is
    staged into one segment for each bucket.  ``strict`` durability stages each
    batch before ``ingest`` returns (the only mode that survives a crash);
    ``fast`` keeps it in the session until the flush.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, durability: str = "strict", safety_lag_ms: int = 60_000, compaction_trigger: int = 16, grace_ms: int = 30_000, max_staged_age_ms: int = 60_000, flush_bytes: int = 64 << 20):
        if durability not in ("strict", "fast"):
            raise ValueError(f"durability is strict or fast, not {durability!r}")
        self.spark, self.root, self.durability = spark, root, durability
        self.safety_lag_ms, self.compaction_trigger, self.grace_ms, self.max_staged_age_ms = safety_lag_ms, compaction_trigger, grace_ms, max_staged_age_ms
        self.flush_bytes = flush_bytes
        os.makedirs(root, exist_ok=True)
        self.catalog = Catalog(root, buckets)
        self._fast: list[DataFrame] = []
        self._classified: list[str] = []
        self._staged_since: int | None = None
        self._recover()

    # ---- state

    @property
    def manifest(self) -> Manifest:
        return self.catalog.manifest

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _staged_paths(self) -> list[str]:
        folder = self._path("staging")
        names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
        return [os.path.join(folder, n) for n in names if os.path.exists(os.path.join(folder, n, "_SUCCESS"))]

    def _recover(self) -> None:
        """Whole staged batches are kept; what a crash left unfinished, or a flush has published, goes."""
        shutil.rmtree(self._path("incoming"), ignore_errors=True)  # batches that no caller got an answer for
        named = {s.path for s in self.manifest.segments} | {p for r in self.manifest.replaced for p in r.paths}
        flushed = {os.path.basename(os.path.dirname(p)) for p in named}
        folder = self._path("staging")
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            done = os.path.join(folder, name, "_FLUSHED")
            if not os.path.exists(os.path.join(folder, name, "_SUCCESS")):
                shutil.rmtree(os.path.join(folder, name))
            elif os.path.exists(done):
                with open(done) as f:
                    flush_id = f.read().strip()
                if flush_id in flushed:
                    shutil.rmtree(os.path.join(folder, name))
                else:
                    os.remove(done)
        self._staged_since = _now_ms() if self._staged_paths() else None

    def close(self) -> None:
        """Flush what is staged and release the lock."""
        self.flush()
        self.catalog.close()

    # ---- reading

    def staged(self) -> DataFrame:
        paths = self._staged_paths()
        out = self.spark.read.schema(RAW_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RAW_SCHEMA)
        for df in self._fast:
            out = out.unionByName(df)
        return out

    def _segments(self, segments: list[SegmentMeta], schema, columns: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema).select(*[c for c in columns if not c.startswith("_metadata")])
        # rollup segments of a tick share files, a segment for each hour; hours are sealed and dropped for all buckets of a tick
        # alike, so one scan of all files and the few hours of each tick's folder give the rows that the manifest names
        paths = sorted({s.path for s in segments})
        sealed = sorted({(os.path.basename(os.path.dirname(s.path)), s.hour_start_ms) for s in segments if s.hour_start_ms is not None})
        df = self.spark.read.schema(schema).parquet(*paths)
        if len({folder for folder, _ in sealed}) == 1:
            df = df.where(F.col("hour_start_ms").isin([hour for _, hour in sealed]))
        elif sealed:
            named = self.spark.createDataFrame(sealed, "folder string, hour_start_ms long")
            df = df.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)).join(F.broadcast(named), ["folder", "hour_start_ms"], "left_semi")
        return df.select(*columns)

    def _buckets(self, accounts) -> dict[str, int] | None:
        if accounts is None:
            return None
        rows = self.spark.createDataFrame([(a,) for a in accounts], "account_id string").select("account_id", bucket_of(self.manifest.bucket_count).alias("b")) if accounts else None
        return {r.account_id: r.b for r in rows.collect()} if rows is not None else {}

    def raw_events(self, from_ms: int = MIN_MS, to_ms: int = MAX_MS, accounts=None, filters=(), manifest: Manifest | None = None) -> DataFrame:
        """Raw events that a query needs: pruned segments and all that is staged."""
        kept = prune((manifest or self.manifest).raw(), from_ms, to_ms, accounts, filters, self._buckets(accounts))
        return self._segments(kept, RAW_SCHEMA, RAW_COLUMNS).unionByName(self.staged())

    def published_events(self) -> DataFrame:
        """Raw events of segments, without what is staged."""
        return self._segments(self.manifest.raw(), RAW_SCHEMA, RAW_COLUMNS)

    def rollup_rows(self, from_ms: int = MIN_MS, to_ms: int = MAX_MS, accounts=None, filters=(), manifest: Manifest | None = None) -> DataFrame:
        kept = prune((manifest or self.manifest).rollups(), from_ms, to_ms, accounts, filters, self._buckets(accounts))
        return self._segments(kept, ROLLUP_SCHEMA, _ROLLUP)

    def query(self, plan: QueryPlan) -> DataFrame:
        """The plan over one snapshot."""
        held = self.manifest
        wm = held.watermark_ms
        sealed = plan.source is Source.ROLLUP
        raw = self.raw_events(max(plan.from_ms, wm) if sealed and not plan.exact_edges else plan.from_ms, plan.to_ms, plan.accounts, plan.filters, held)
        rolled = self.rollup_rows(plan.from_ms, min(plan.to_ms, wm), plan.accounts, plan.filters, held) if sealed else None
        return compile_plan(plan, raw, rolled, wm)

    def sql(self, text: str) -> DataFrame:
        return self.query(parse_sql(text))

    # ---- ingest

    def closed_periods(self) -> DataFrame:
        rows = [(c.account_id, f"{c.year:04d}-{c.month:02d}") for c in self.manifest.closed]
        return self.spark.createDataFrame(rows, "account_id string, period string")

    def ingest(self, batch: DataFrame, now_ms: int | None = None) -> dict[str, int]:
        """Validate, gate, classify and stage a batch; returns ``accepted, duplicates, conflicts, rejected``.

        Conflicts are kept in a side table for review.
        """
        now_ms = _now_ms() if now_ms is None else now_ms
        if "batch_pos" not in batch.columns:
            batch = ingest.number_batch(batch)
        path = self._path("incoming", uuid.uuid4().hex)
        # numbered rows are written before any shuffle, so that "first wins" is settled once
        checked = ingest.gate_closed(ingest.validate(batch), self.closed_periods())
        checked.withColumn("ingested_at_ms", F.lit(now_ms)).select(*RAW_COLUMNS, "batch_pos", "reject_reason").write.parquet(path)
        try:
            checked = self.spark.read.parquet(path)
            valid = checked.where("reject_reason is null").drop("reject_reason")
            since_ms = now_ms - ingest.DEDUPE_TTL_MS
            known = self._fast or self._staged_paths() or any(x.max_ingested_ms >= since_ms for x in self.manifest.indexes)
            index = self.dedupe_index(since_ms).where(F.col("ingested_at_ms") >= since_ms) if known else None
            several, once = self._by_repetition(valid, index, path + "-repeated")
            classified_path = path + "-classified"
            ingest.classify(several, index, now_ms).write.parquet(classified_path)
            classified = self.spark.read.parquet(classified_path)
            counts = {r.status: r["count"] for r in classified.groupBy("status").count().collect()}
            new = classified.where("status = 'new'").select(*RAW_COLUMNS)
            if once is not None:
                counts["new"] = counts.get("new", 0) + once.count()
                new = new.unionByName(once.select(*RAW_COLUMNS))
            rejected = checked.where("reject_reason is not null").count()
            if counts.get("new"):
                self._stage(new, now_ms)
            if counts.get("conflict"):
                classified.where("status = 'conflict'").select(*RAW_COLUMNS).write.mode("append").parquet(self._path("conflicts"))
        finally:
            shutil.rmtree(path, ignore_errors=True)
            shutil.rmtree(path + "-repeated", ignore_errors=True)
            if self._fast:  # what is staged in the session reads it until the flush
                self._classified.append(path + "-classified")
            else:
                shutil.rmtree(path + "-classified", ignore_errors=True)
        if sum(os.path.getsize(os.path.join(p, f)) for p in self._staged_paths() for f in os.listdir(p)) > self.flush_bytes:
            self.flush()
        return {"accepted": counts.get("new", 0), "duplicates": counts.get("duplicate", 0), "conflicts": counts.get("conflict", 0), "rejected": rejected}

    def _by_repetition(self, valid: DataFrame, index: DataFrame | None, path: str) -> tuple[DataFrame, DataFrame | None]:
        """Events to be classified, and those that are new as nothing else has their ids; these aren't shuffled or written for it.

        All are classified if many ids are repeated, and in ``fast`` durability, where what is new is read from the classified table.
        """
        if self.durability == "fast":
            return valid, None
        ingest.repeated_ids(valid, index).write.parquet(path)
        repeated = self.spark.read.schema("id_hash long").parquet(path)
        if repeated.count() > ingest.FEW_IDS:
            return valid, None
        return ingest.with_ids(valid, repeated, True), ingest.with_ids(valid, repeated, False)

    def dedupe_index(self, since_ms: int) -> DataFrame:
        """Ids and digests of events ingested since then: the narrow tables of flushes that are recent enough, and what is staged."""
        paths = [x.path for x in self.manifest.indexes if x.max_ingested_ms >= since_ms]
        staged = ingest.dedupe_index(self.staged())
        return self.spark.read.schema(_INDEX).parquet(*paths).unionByName(staged) if paths else staged

    def _stage(self, events: DataFrame, now_ms: int) -> None:
        if self.durability == "strict":
            events.write.parquet(self._path("staging", uuid.uuid4().hex))
        else:
            self._fast.append(events)
        self._staged_since = now_ms if self._staged_since is None else self._staged_since

    def conflicts(self) -> DataFrame:
        """Conflicting events, each once, however often its batch was sent again."""
        path = self._path("conflicts")
        if not os.path.isdir(path):
            return self.spark.createDataFrame([], RAW_SCHEMA)
        found = self.spark.read.schema(RAW_SCHEMA).parquet(path).withColumn("digest", payload_hash())
        return found.groupBy("event_id", "digest").agg(F.min_by(F.struct(*RAW_COLUMNS), "ingested_at_ms").alias("first")).select("first.*")

    def _write_segments(self, events: DataFrame, folder: str, kind: str = "raw") -> list[SegmentMeta]:
        """One directory a bucket, rows in canonical order; the segments aren't visible until they are committed."""
        rows = rollup.with_bucket(events, self.manifest.bucket_count)
        path = self._path(kind, folder)
        rollup.in_canonical_order(rows).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        written = self.spark.read.schema(_with_bucket()).parquet(path)
        return [
            SegmentMeta(f"{folder}-{r.bucket}", kind, r.bucket, os.path.join(path, f"bucket={r.bucket}"), r.row_count, r.min_timestamp_ms, r.max_timestamp_ms, r.min_account, r.max_account, tuple(r.products), tuple(r.meters), tuple(r.models), str(r.quantity_sum))
            for r in rollup.segment_statistics(written, "bucket").orderBy("bucket").collect()
        ]

    def flush(self) -> int:
        """Publish what is staged as segments; returns how many. All buckets become visible by one commit, or none."""
        paths = self._staged_paths()
        if not paths and not self._fast:
            return 0
        folder = f"flush-{self.manifest.generation + 1:06d}-{uuid.uuid4().hex[:8]}"
        made = self._write_segments(self.staged(), folder)
        index = self._path("dedupe", folder)
        ingest.dedupe_index(self.staged()).sortWithinPartitions("event_id").write.option("compression", "zstd").parquet(index)
        newest = self.staged().agg(F.max("ingested_at_ms")).first()[0]
        for p in paths:
            with open(os.path.join(p, "_FLUSHED"), "w") as f:
                f.write(folder)
        self.catalog.commit(segments=(*self.manifest.segments, *made), indexes=(*self.manifest.indexes, DedupeIndex(index, newest)))
        for p in paths:
            shutil.rmtree(p)
        self._fast, self._staged_since = [], None
        for p in self._classified:
            shutil.rmtree(p, ignore_errors=True)
        self._classified = []
        return len(made)

    # ---- rollups

    def tick(self, now_ms: int | None = None) -> int:
        """Seal the hours that are safe to seal; returns how many rollup segments were made.

        The watermark never passes the safety lag or the hour of an event that is
        still staged; staged events that are too old are flushed first. Without
        any raw segment it stays where it is.
        """
        now_ms = _now_ms() if now_ms is None else now_ms
        if self._staged_since is not None and now_ms - self._staged_since >= self.max_staged_age_ms:
            self.flush()
        held = self.manifest
        if not held.raw():
            return 0
        target = (now_ms - self.safety_lag_ms) // HOUR_MS * HOUR_MS
        oldest = self.staged().agg(F.min("timestamp_ms")).first()[0]
        if oldest is not None:
            target = min(target, oldest // HOUR_MS * HOUR_MS)
        start = held.watermark_ms or min(s.min_timestamp_ms for s in held.raw()) // HOUR_MS * HOUR_MS
        if target <= start:
            return 0
        done = {(s.hour_start_ms, s.bucket) for s in held.rollups()}
        made = self._build_rollups(held, start, target, done)
        self.catalog.commit(segments=(*held.segments, *made), watermark_ms=target)
        return len(made)

    def _build_rollups(self, held: Manifest, start: int, target: int, done: set) -> list[SegmentMeta]:
        """All hours of the range in one job; a segment for each hour and bucket that isn't sealed yet, in one directory of files."""
        inputs = prune(held.raw(), start, target)
        if not inputs:
            return []
        folder = f"tick-{held.generation + 1:06d}-{uuid.uuid4().hex[:8]}"
        path = self._path("rollup", folder)
        raw = in_range(self._segments(inputs, RAW_SCHEMA, [*RAW_COLUMNS, "_metadata.file_path"]), "timestamp_ms", start, target)
        # a segment is the directory of a flush and a bucket
        part = lambda group: F.regexp_extract("file_path", r"/([^/]+)/bucket=(\d+)/[^/]*$", group)
        raw = raw.select(*RAW_COLUMNS, part(2).cast("int").alias("bucket"), F.concat_ws("-", part(1), part(2)).alias("segment_id"))
        rows = rollup.hourly_rollup(raw, "bucket")
        if done:
            sealed = self.spark.createDataFrame(sorted(done), "hour_start_ms long, bucket int")
            rows = rows.join(sealed, ["hour_start_ms", "bucket"], "left_anti")
        rows.select(*_ROLLUP, "bucket").repartitionByRange("bucket", "hour_start_ms", "account_id").sortWithinPartitions("bucket", "hour_start_ms", "account_id").write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        lineage = {(r.hour_start_ms, r.bucket): tuple(r.inputs) for r in rollup.rollup_lineage(raw).collect()}
        written = self.spark.read.parquet(path)
        if not written.columns or "hour_start_ms" not in written.columns:
            return []
        stats = rollup.segment_statistics(written.select("*", F.col("hour_start_ms").alias("timestamp_ms"), F.col("quantity_sum").alias("quantity")), "bucket", "hour_start_ms")
        return [
            SegmentMeta(f"{folder}-{r.bucket}-{r.hour_start_ms}", "rollup", r.bucket, os.path.join(path, f"bucket={r.bucket}"), r.row_count, r.hour_start_ms, r.hour_start_ms + HOUR_MS - 1, r.min_account, r.max_account, tuple(r.products), tuple(r.meters), tuple(r.models), str(r.quantity_sum), r.hour_start_ms, lineage.get((r.hour_start_ms, r.bucket), ()))
            for r in stats.orderBy("hour_start_ms", "bucket").collect()
        ]

    def rebuild_rollups(self, from_ms: int, to_ms: int) -> int:
        """Drop the rollups of a range (floored to the hour) and move the watermark back to its start; the next tick fills it. Returns how many went."""
        from_ms = from_ms // HOUR_MS * HOUR_MS
        held = self.manifest
        gone = [s for s in held.rollups() if s.min_timestamp_ms < to_ms and s.max_timestamp_ms >= from_ms]
        ids = {s.segment_id for s in gone}
        # later hours of the same files stay, and stay sealed; hours above the watermark aren't read from rollups
        self.catalog.commit(segments=tuple(s for s in held.segments if s.segment_id not in ids), watermark_ms=min(held.watermark_ms, from_ms))
        return len(gone)

    # ---- compaction

    def compact(self, now_ms: int | None = None) -> dict[str, int]:
        """Delete replaced files past their grace, then merge each bucket with more segments than the trigger."""
        now_ms = _now_ms() if now_ms is None else now_ms
        removed = self._sweep(now_ms)
        merged = 0
        by_bucket: dict[int, list[SegmentMeta]] = {}
        for s in self.manifest.raw():
            by_bucket.setdefault(s.bucket, []).append(s)
        due = {b: x for b, x in by_bucket.items() if len(x) > self.compaction_trigger}
        if due:
            inputs = [s for x in due.values() for s in x]
            folder = f"compact-{self.manifest.generation + 1:06d}-{uuid.uuid4().hex[:8]}"
            events = self._segments(inputs, RAW_SCHEMA, RAW_COLUMNS)
            made = self._write_segments(ingest.first_by_id(events), folder)
            ids = {s.segment_id for s in inputs}
            if not ids <= {s.segment_id for s in self.manifest.segments}:
                raise RuntimeError("a segment went while it was compacted")
            new = {s.bucket: s.segment_id for s in made}
            records = tuple(Replacement(tuple(s.segment_id for s in x), tuple(s.path for s in x), new[b], now_ms) for b, x in due.items())
            self.catalog.commit(segments=(*[s for s in self.manifest.segments if s.segment_id not in ids], *made), replaced=(*self.manifest.replaced, *records))
            merged = len(due)
        return {"compacted": merged, "removed": removed}

    def _sweep(self, now_ms: int) -> int:
        stale = [x for x in self.manifest.indexes if x.max_ingested_ms < now_ms - ingest.DEDUPE_TTL_MS]
        if stale:
            self.catalog.commit(indexes=tuple(x for x in self.manifest.indexes if x not in stale))
            for x in stale:
                shutil.rmtree(x.path, ignore_errors=True)
        old = [r for r in self.manifest.replaced if r.committed_at_ms and r.committed_at_ms <= now_ms - self.grace_ms]
        if old:
            self.catalog.commit(replaced=tuple(r for r in self.manifest.replaced if r not in old))
            for r in old:
                for p in r.paths:
                    shutil.rmtree(p, ignore_errors=True)
        return len(old)

    # ---- periods

    def _totals(self, account_id: str, from_ms: int, to_ms: int) -> dict:
        plan = QueryPlan(Source.ROLLUP, from_ms, to_ms, (account_id,), (), (), (("quantity", Metric.SUM), ("count", Metric.COUNT), ("events", Metric.EVENTS)))
        return self.query(plan).first().asDict()

    def close_period(self, account_id: str, year: int, month: int, now_ms: int | None = None) -> dict:
        """Freeze a month's totals and refuse further usage in it; closing again keeps the first snapshot.

        If rollups have drifted from raw events (late data below the watermark), the
        month's rollups are rebuilt first, so that nothing late is left out.
        """
        now_ms = _now_ms() if now_ms is None else now_ms
        held = self.manifest.closed_period(account_id, year, month)
        if held:
            return self._closed(held) | {"already_closed": True}
        low, high = period_bounds(year, month)
        self.flush()
        if self.verify(account_id, low, high)["drift"]:
            back = self.manifest.watermark_ms
            self.rebuild_rollups(low, high)
            self.tick(back + self.safety_lag_ms)
        totals = self._totals(account_id, low, high)
        made = ClosedPeriod(account_id, year, month, now_ms, self.manifest.watermark_ms, str(totals["quantity"]), totals["count"], totals["events"])
        self.catalog.commit(closed=(*self.manifest.closed, made))
        return self._closed(made)

    @staticmethod
    def _closed(c: ClosedPeriod) -> dict:
        frozen = None if c.quantity is None else {"quantity": c.quantity, "event_count": c.count, "exact_event_count": c.events}
        return {"account_id": c.account_id, "period": f"{c.year:04d}-{c.month:02d}", "state": "Closed", "closed_at_ms": c.closed_at_ms, "watermark_at_close_ms": c.watermark_ms, "frozen": frozen}

    def reopen_period(self, account_id: str, year: int, month: int) -> dict:
        held = self.manifest.closed_period(account_id, year, month)
        if held:
            self.catalog.commit(closed=tuple(c for c in self.manifest.closed if c != held))
        return {"account_id": account_id, "period": f"{year:04d}-{month:02d}", "state": "Open", "removed": held is not None}

    def get_period(self, account_id: str, year: int, month: int) -> dict:
        """An open month's live total, or a closed one's frozen totals and what was adjusted since."""
        low, high = period_bounds(year, month)
        held = self.manifest.closed_period(account_id, year, month)
        base = {"account_id": account_id, "period": f"{year:04d}-{month:02d}", "from_ms": low, "to_ms": high}
        if held is None:
            return base | {"state": "Open", "closed_at_ms": None, "total_quantity": str(self._totals(account_id, low, high)["quantity"])}
        rows = audit.adjustments(self.raw_events(low, high, (account_id,)), account_id, low, high, held.closed_at_ms)
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quantity"), F.lit(0)).cast("decimal(38,0)").alias("q")).first()
        out = base | self._closed(held) | {"pending_adjustments": found.n, "adjustments_quantity": str(found.q)}
        if held.quantity is None:
            live = self._totals(account_id, low, high)["quantity"]
            return out | {"warning": "closed without a snapshot", "live_total_fallback": str(live), "net_total": str(live)}
        return out | {"net_total": str(Decimal(held.quantity) + found.q)}

    # ---- audit

    def verify(self, account_id: str, from_ms: int, to_ms: int) -> dict:
        held = self.manifest
        mine = F.col("account_id") == account_id
        raw = self.raw_events(from_ms, to_ms, (account_id,), manifest=held).where(mine)
        rolled = self.rollup_rows(from_ms, min(to_ms, held.watermark_ms), (account_id,), manifest=held).where(mine)
        row = audit.drift(raw, rolled, from_ms, to_ms, held.watermark_ms).first().asDict()
        return {"account_id": account_id, "from_ms": from_ms, "to_ms": to_ms, "watermark_ms": held.watermark_ms, **row}

    def explain(self, account_id: str, from_ms: int, to_ms: int) -> dict:
        """Breakdown lines, corrections, and the segments behind them."""
        held, who = self.manifest, (account_id,)
        raw = self.raw_events(from_ms, to_ms, who, manifest=held)
        rolled = self.rollup_rows(from_ms, min(to_ms, held.watermark_ms), who, manifest=held)
        rows = stitch(raw, rolled, held.watermark_ms, from_ms, to_ms).where(F.col("account_id") == account_id)
        lines = audit.explain_lines(rows).orderBy(*audit.EXPLAIN_KEYS).collect()
        fixes = audit.adjustments(raw, account_id, from_ms, to_ms).orderBy("timestamp_ms", "event_id").collect()
        buckets = self._buckets(who)
        sealed = prune(held.rollups(), from_ms, min(to_ms, held.watermark_ms), who, (), buckets)
        tail = prune(held.raw(), max(from_ms, held.watermark_ms), to_ms, who, (), buckets)
        return {
            "account_id": account_id,
            "from_ms": from_ms,
            "to_ms": to_ms,
            "watermark_ms": held.watermark_ms,
            "lines": [r.asDict() for r in lines],
            "rollup_segments": [s.segment_id for s in sealed],
            "rollup_inputs": {s.segment_id: list(s.inputs) for s in sealed},
            "raw_segments": [s.segment_id for s in tail],
            "corrections": [r.asDict(recursive=True) for r in fixes],
        }

    def check(self, deep: bool = False) -> dict:
        """Summary of the manifest; deep: every segment's rows and quantity are read and compared with it."""
        held = self.manifest
        out = {"generation": held.generation, "watermark_ms": held.watermark_ms, "raw_segments": len(held.raw()), "rollup_segments": len(held.rollups()), "rows": sum(s.row_count for s in held.raw()), "quantity": str(held.quantity()), "closed_periods": len(held.closed)}
        if deep:
            bad = []
            for s in held.segments:
                try:
                    df = self._segments([s], RAW_SCHEMA, RAW_COLUMNS) if s.kind == "raw" else self._segments([s], ROLLUP_SCHEMA, _ROLLUP)
                    rows, total = df.agg(F.count(F.lit(1)), F.sum("quantity" if s.kind == "raw" else "quantity_sum")).first()
                    if rows != s.row_count or Decimal(total or 0) != Decimal(s.quantity_sum):
                        bad.append(s.segment_id)
                except Exception as error:  # noqa: BLE001  any unreadable file is a finding
                    bad.append(f"{s.segment_id}: {type(error).__name__}")
            out["failed"] = bad
            if bad:
                raise RuntimeError(f"segments fail the deep check: {bad}")
        return out

    def inspect_segment(self, segment_id: str, rows: int = 5) -> dict:
        found = next((s for s in self.manifest.segments if s.segment_id == segment_id), None)
        if found is None:
            raise KeyError(segment_id)
        sample = self._segments([found], RAW_SCHEMA, RAW_COLUMNS).limit(rows).collect() if found.kind == "raw" else []
        return {"meta": found, "sample": [r.asDict(recursive=True) for r in sample], "lineage": list(found.inputs)}


def _with_bucket() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMA) + ", bucket int"
