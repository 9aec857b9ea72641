"""Near-duplicate documents by the similarity of their sets of word shingles (Jaccard).

Candidates are documents whose SimHash fingerprints ``simhash_dedup`` links through its
popcount segments (``MAX_BITS`` or fewer bits apart, and what such links connect), and, as few documents of
that similarity are so near, those that share one of ``BANDS`` bands of ``ROWS`` minimum hashes; two documents of
similarity s share none with a probability of (1 - s^5)^30, which is 7 in a
million at 0.8 and less above.  Candidates are verified by the exact similarity of
the sets (of shingles' 64-bit hashes).  Equal texts are one row from the start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import connected_cells
from .common import discard, durable, only, own_exchange, python_ready, stored
from .simhash_dedup import fingerprint_roots, fingerprints

BANDS, ROWS, SEED = 30, 5, 42
SIMILARITY = 0.8
MAX_BITS = 4
_DICE = np.random.Generator(np.random.PCG64(SEED))
_XOR = _DICE.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _DICE.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = text.encode().lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    parts = (b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1) if words else 0))
    return np.unique(np.fromiter((digest(x, SEED) for x in parts), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of each band of minimum hashes, signed; no shingles give no bands."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[None, k : k + 2048] ^ _XOR) * _ODD).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _texts(docs: DataFrame, shingle: int, made, column: str, kind: str) -> DataFrame:
    """``t`` and what ``made`` gives for the shingles of each row's ``text``."""
    python_ready(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = [made(shingles(x, shingle)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["t", column])

    return docs.select("t", "text").mapInArrow(work, f"t long, {column} {kind}")


def _grouped(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc_id, t, root`` of each row: the hash of its text and of the text that stands for its group.

    Null texts count as empty; texts without words are equal to their like only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    keyed = _texts(rows, shingle, bands, "bands", "array<long>").select("t", F.explode("bands").alias("key"))
    prints = durable(fingerprints(rows.select(F.col("t").alias("doc_id"), "text").where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))), shingle).distinct().select(F.col("doc_id").alias("t"), "fp"))
    near = prints.join(fingerprint_roots(prints, MAX_BITS), "fp", "left").select(F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("key"), "t")
    keyed = stored(keyed.unionByName(near).select("key", F.col("t").alias("id")).distinct(), "bands")

    def sets(wanted: DataFrame) -> DataFrame:
        texts = rows.select("t", "text").join(wanted.withColumnRenamed("id", "t"), "t", "left_semi").dropDuplicates(["t"])
        found = _texts(texts, shingle, lambda x: x.view(np.int64), "s", "array<long>")
        return found.select(F.col("t").alias("id"), "s", F.size("s").alias("n"))

    def possible(a: str, b: str) -> Column:
        return F.least(f"n{a}", f"n{b}") >= similarity * F.greatest(f"n{a}", f"n{b}") - 1e-9

    def similar(a: str, b: str) -> Column:
        both = F.size(F.array_intersect(f"s{a}", f"s{b}"))
        return possible(a, b) & (both >= similarity * (F.col(f"n{a}") + F.col(f"n{b}") - both) - 1e-9)

    roots = connected_cells(keyed, sets, similar, ("n",), possible)
    discard(keyed)
    return durable(rows.select("doc_id", "t").join(roots.withColumnRenamed("node", "t"), "t", "left").select("doc_id", "t", F.coalesce("root", "t").alias("root")))


def components(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of each row: the least doc_id that links of similar documents reach."""
    ids = _grouped(docs, shingle, similarity)
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return ids.join(least.select(own_exchange("root"), "component_id"), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group: that of the least doc_id (null last); of several texts with that doc_id, the one of the least hash.

    So a row goes because of its own text, never because another row of its doc_id is a copy,
    and of repeated rows one stays.
    """
    ids = _grouped(docs, shingle, similarity)
    least = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("d"), "t")).alias("least"))
    return only(docs, durable(least.select("least.d", "least.t")))
