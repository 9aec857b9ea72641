"""Command line: ``python -m meterloom.admin --db-root DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from .periods import format_time, parse_time
from .service import UsageService, Workers, serve, to_json
from .sources.export import export_parquet
from .store import UsageStore


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="meterloom")
    out.add_argument("--db-root", default="./data")
    commands = out.add_subparsers(dest="command")
    run = commands.add_parser("serve", help="serve HTTP (the default)")
    run.add_argument("--host", default="127.0.0.1")
    run.add_argument("--port", type=int, default=8080)
    commands.add_parser("check", help="summary of the manifest").add_argument("--deep", action="store_true", help="read every segment")
    again = commands.add_parser("rebuild-rollups", help="drop the rollups of a range; the next tick fills it")
    again.add_argument("--from", dest="low", required=True)
    again.add_argument("--to", dest="high", required=True)
    commands.add_parser("inspect-segment", help="a segment's statistics, lineage and first rows").add_argument("segment_id")
    period = commands.add_parser("verify-period", help="raw totals against rollups")
    period.add_argument("--account", required=True)
    period.add_argument("--from", dest="low", required=True)
    period.add_argument("--to", dest="high", required=True)
    export = commands.add_parser("export-parquet", help="flat Parquet of the published segments")
    export.add_argument("path")
    export.add_argument("--single-file", action="store_true")
    commands.add_parser("compact", help="one pass of compaction")
    commands.add_parser("tick", help="one pass of the rollup worker")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("meterloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = UsageStore(spark, args.db_root)
    show = lambda value: print(json.dumps(to_json(value), indent=1), file=out)
    try:
        match args.command:
            case "check":
                show(store.check(args.deep))
            case "rebuild-rollups":
                show({"dropped": store.rebuild_rollups(parse_time(args.low), parse_time(args.high)), "watermark": format_time(store.manifest.watermark_ms)})
            case "inspect-segment":
                found = store.inspect_segment(args.segment_id)
                show(found | {"meta": asdict(found["meta"])})
            case "verify-period":
                show(store.verify(args.account, parse_time(args.low), parse_time(args.high)))
            case "export-parquet":
                export_parquet(store.published_events(), args.path, args.single_file)
                show({"exported": args.path, "rows": sum(s.row_count for s in store.manifest.raw())})
            case "compact":
                show(store.compact())
            case "tick":
                show({"segments": store.tick(), "watermark_ms": store.manifest.watermark_ms})
            case _:
                service = UsageService(store)
                workers = Workers(service)
                server = serve(service, getattr(args, "host", "127.0.0.1"), getattr(args, "port", 8080))
                try:
                    server.serve_forever()
                except KeyboardInterrupt:
                    server.server_close()
                finally:
                    workers.stop()
        return 0
    except (ValueError, KeyError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    finally:
        if args.command in (None, "serve"):
            store.close()
        else:
            store.catalog.close()


if __name__ == "__main__":
    sys.exit(main())
