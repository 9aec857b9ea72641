"""Helpers shared by the operators: durable cuts of the lineage and shipping of this package."""

from __future__ import annotations

import contextlib
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows for a byte of a file, for Spark's choice of what to broadcast.
INFLATED = 16.0
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table by the path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a temporary folder is
    made once and becomes the session's checkpoint folder; a cluster must name one.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not held.isDefined():
            context.setCheckpointDir(named)
        return named
    if held.isDefined():
        return held.get()
    if not re.match(r"local($|\[)", context.master):
        raise RuntimeError("spark.checkpoint.dir names no folder; driver and executors must share one")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="meterloom-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def small_broadcasts(spark: SparkSession, size: str = "256k") -> None:
    """Let a broadcast reserve blocks of ``size`` on the driver's heap, unless the session names another size.

    Every stage, scan and broadcast join sends a broadcast, mostly of a few KB, and reserves a whole block of 4 MB for each one. G1 keeps
    those apart from all else, so hundreds of small jobs drive the heap to its limit, though little on it is in use.
    """
    conf = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()
    if not conf.contains("spark.broadcast.blockSize"):
        conf.set("spark.broadcast.blockSize", size)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, empty path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let the driver find what nothing refers to any more, so that Spark deletes its shuffle files and checkpoints and the heap shrinks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def _wary(spark: SparkSession):
    """Spark takes a Parquet file's bytes for its rows' size; those of repeated keys and ascending ids are up to some 20 times as large once broadcast."""
    key = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(float(before), INFLATED)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor takes nothing with it.

    Spark carries the estimated size over a checkpoint. A join multiplies the sizes of its sides, so the digits of that number double and more with
    each round of a loop until it takes most of the driver's heap and time; here the size is unknown again.
    """
    spark = df.sparkSession
    shared_dir(spark)
    small_broadcasts(spark)
    with _wary(spark):
        kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().logical().rdd()
    kept = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
    release(spark)
    return kept


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: a cut like ``durable``, for wide rows."""
    path = scratch_dir(df.sparkSession, label)
    small_broadcasts(df.sparkSession)
    with _wary(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made and that nothing reads any more: what came of them has been cut from them."""
    for kept in tables:
        context = kept.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(kept._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``d, t`` (doc_id and hash of the text) of ``kept``, which is durable and has no repeated rows.

    Of rows that repeat both, that of the least JSON hash stays.
    """
    names = docs.columns
    row, d, t, n = (fresh(names, x) for x in ("row0", "d0", "t0", "n0"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col("doc_id").alias(d), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(t))
    same = lambda other: rows[d].eqNullSafe(other["d"]) & (rows[t] == other["t"])
    kept = kept.select("d", "t")
    repeated = durable(rows.groupBy(d, t).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col(d).alias("d"), F.col(t).alias("t")))
    single = rows.join(kept, same(kept), "left_semi")
    if not repeated.isEmpty():
        many = single.join(repeated, same(repeated), "left_semi")
        single = single.join(repeated, same(repeated), "left_anti").select(row)
        many = many.groupBy(d, t).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(row)).select(row)
        single = single.unionByName(many)
    return single.select(*[F.col(row).getField(c).alias(c) for c in names])


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once a session), wherever the driver imported it from."""
    context = spark.sparkContext
    if getattr(context, "_meterloom_shipped", False):
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="meterloom-code-"))
    name = os.path.basename(_PACKAGE)
    copy = os.path.join(folder, "code", name)
    shutil.copytree(_PACKAGE, copy, ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(folder, f"{name}-code"), "zip", os.path.join(folder, "code"))
    context.addPyFile(archive)
    context._meterloom_shipped = True


def own_exchange(key):
    """A long join key whose side gets an exchange of the join's own, although an aggregation has dealt it out already.

    Adaptive execution splits skewed partitions only of exchanges that stand right below the join.
    """
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, since texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def python_ready(spark: SparkSession) -> None:
    """What a plan with Python workers needs first."""
    ship(spark)
    small_batches(spark)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until it clashes with no name in ``taken`` (in either case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def word_array(text):
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column, as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
