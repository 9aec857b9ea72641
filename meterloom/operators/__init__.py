"""Ingest, rollup, compaction, periods and audit as DataFrame functions."""
