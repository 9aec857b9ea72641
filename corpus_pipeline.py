"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.llm import decontaminate, line_dedup, packing, quality, shingle_dedup
from meterloom.llm.common import scratch_dir, table
from meterloom.llm.queries import SEQUENCE_TOKENS, WINDOW, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark, docs, sf_dir):
    """Documents without lines that repeat earlier ones; those with no words left go."""
    cleaned = line_dedup.dedup_lines(docs).drop("n_removed", "removed")
    cleaned = cleaned.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """One document of each group with a similarity of 0.8 or more of their five-word shingles."""
    return shingle_dedup.one_of_each(docs, shingle=5)


def decontamination(spark, docs, sf_dir):
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def packing_stage(spark, docs, sf_dir):
    """The pieces of every document, packed to sequences."""
    return packing.pack_documents(docs, tokenizer_path(), SEQUENCE_TOKENS)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Stages 2 to 5 can't be expressed in SQL; tests hold the operators against brute force, and the stages against what they may do.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
