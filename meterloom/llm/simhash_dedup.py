"""Near-duplicate documents by SimHash, found through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts (0, 1 or 2) of its 32 segments
of two bits.  The Manhattan distance of two such vectors is a lower bound of the
Hamming distance of the fingerprints.  The vectors are joined on a grid: their
coordinates are dealt to ``max_bits + k`` bands, so two vectors at a distance of
``max_bits`` or less agree in at least ``k`` bands, and the cells are the unit
cells of every ``k`` bands.  ``k`` follows from the number of fingerprints: more bands
make more, but smaller cells, and whatever it is no link is lost.  What shares a cell is compared under the
Manhattan bound and then verified exactly.

Only distinct fingerprints are joined, so copies of a text cost one row.  A cell
with many fingerprints is split to blocks, and every pair of blocks is a task's
work of its own; a pair of blocks gives the links of a spanning forest, never
all its pairs, and so loses no connection.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, only, own_exchange, python_ready
from .components import connected_components

SEED = 42
#: Fingerprints of a block of a cell.
BLOCK = 1024
_LOW = 0x5555555555555555
_BITS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def simhash(text: str | None, shingle: int) -> int:
    """Unsigned fingerprint: a bit is 1 if it is in over half the hashes of the word shingles (repeats included)."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[:-shingle].tolist()]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # most significant bit first
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(_BITS[ones * 2 > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``doc_id, fp`` of whole texts: words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, ``fp`` as a signed long."""
    python_ready(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([simhash(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def _embedding(fp: Column) -> Column:
    """The 32 bit counts, two bits each, in one long."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def agreeing_bands(fingerprints: int, max_bits: int) -> int:
    """Bands that a cell is made of: those with the least work, a comparison being a hundredth of a row's.

    A segment's counts are equal by chance in three of eight cases.
    """
    work = lambda k: comb(max_bits + k, k) * (1 + fingerprints * 0.375 ** (32 * k / (max_bits + k)) / 100)
    return min(range(2, 9), key=work)


def _cells(max_bits: int, agreeing: int = 2) -> list[int]:
    """Masks of the embedding's coordinates in each choice of agreeing bands, as signed longs."""
    bands = np.array_split(np.arange(32), max_bits + agreeing)
    masks = [sum(3 << (2 * int(s)) for band in some for s in bands[band]) for some in combinations(range(max_bits + agreeing), agreeing)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings: of each two-bit count, |a - b| is 0, 1 or 2."""
    low, one = np.uint64(_LOW), np.uint64(1)
    differ = a ^ b
    odd, high = differ & low, (differ >> one) & low
    # counts are 0, 1, 2: they differ by two if only the high bits differ (0 and 2), else by one (1 with 0 or 2)
    return np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(high & ~odd).astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Merge the labels (least place) of linked places, in ``label`` itself."""
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(label, label[label]):
            label[:] = label[label]
        if np.array_equal(before, label):
            return


def links_in_groups(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of fingerprints at ``max_bits`` or less in groups that stand together."""
    fp = fp.view(np.uint64)
    low, one = np.uint64(_LOW), np.uint64(1)
    x, y = fp & low, (fp >> one) & low
    embedded = (x ^ y) | ((x & y) << one)
    label = np.arange(len(fp))
    cut = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
    last = np.repeat(cut[1:], np.diff(cut))  # end of each row's group
    i, lag, held, size = np.arange(len(fp)), 1, [], 0
    while True:
        i = i[i + lag < last[i]]
        if not len(i):
            break
        j = i + lag
        near = _manhattan(embedded[i], embedded[j]) <= max_bits
        near[near] = np.bitwise_count(fp[i[near]] ^ fp[j[near]]) <= max_bits
        held.append((i[near], j[near]))
        size += len(held[-1][0])
        if size > 1 << 20:
            _forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), label)
            held, size = [], 0
        lag += 1
    if held:
        _forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), label)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked].view(np.int64), fp[label[linked]].view(np.int64)


def fingerprint_links(fps: DataFrame, max_bits: int = 4, block: int = BLOCK, agreeing: int | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``) that connect all that differ in ``max_bits`` or fewer."""
    spark = fps.sparkSession
    python_ready(spark)
    embedded = _embedding(F.col("fp"))
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), embedded.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(_cells(max_bits, agreeing or agreeing_bands(fps.count(), max_bits)))])).alias("x")).select("x.k", "x.cell", "fp")
    counts = keyed.groupBy("k", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("fp", "k"), blocks)
    other = F.explode(F.when(blocks <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))).alias("other")
    members = (
        keyed.join(counts.select("k", own_exchange("cell"), "n"), ["k", "cell"])
        .select("k", "cell", "fp", own.alias("own"), other)
        # a pair of blocks is one group, and it goes to one task
        .select(F.xxhash64("k", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "fp")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.repartition(n, "grp").sortWithinPartitions("grp")

    def work(batches):
        import pyarrow as pa

        def out(group, fp):
            a, b = links_in_groups(group, fp, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            rows += batch.num_rows
            if rows >= 100_000:
                group, fp = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
                if whole:
                    yield out(group[:whole], fp[:whole])
                held, rows = [(group[whole:], fp[whole:])], len(group) - whole
        if rows:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return ordered.mapInArrow(work, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 5, max_bits: int = 4) -> DataFrame:
    """A row for each document: ``doc_id, fp, component_id`` (the least doc_id that links reach).

    Texts without words (null, empty, white space) have fingerprint zero and link
    like any others; equal texts have equal fingerprints; a null doc_id takes
    part but is no component's id unless all are null; rows that repeat a doc_id
    each get a row; other columns are ignored; an empty table gives no rows.
    """
    prints = durable(fingerprints(docs, shingle))
    roots = fingerprint_roots(prints, max_bits)
    ids = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return ids.join(least.select(own_exchange("root"), "component_id"), "root").select("doc_id", "fp", "component_id")


def fingerprint_roots(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root`` of every fingerprint that is linked to another one."""
    distinct = durable(prints.select("fp").distinct())
    return connected_components(fingerprint_links(distinct, max_bits)).select(F.col("node").alias("fp"), "root")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``simhash_components``."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 5, max_bits: int = 4) -> DataFrame:
    """One row of each group: that of the least doc_id (null last); of several texts with that doc_id, the one of the least hash.

    So a row goes because of its own text, and of repeated rows one stays.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text"))
    prints = durable(fingerprints(texts, shingle).distinct().select(F.col("doc_id").alias("t"), "fp"))
    groups = prints.join(fingerprint_roots(prints, max_bits), "fp", "left").select("t", F.coalesce("root", "fp").alias("root"))
    named = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t")).join(groups, "t")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("unnamed"), "d", "t")).alias("least"))
    return only(docs, durable(least.select("least.d", "least.t")))
