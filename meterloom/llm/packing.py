"""Best-fit packing of token sequences, bulk-synchronous over size classes.

Documents of one length are interchangeable, and so are gaps of one size.  A
round therefore works on runs: it takes the documents of the next length (they
are range-sorted by length, so each has a rank in its class), sweeps for the
successor gap, the smallest that holds that length, matches the class's ranks
with the ranks of that run of gaps in one step, updates the gaps, and repeats
with what is left of the class.  No two documents get one place, since both
sides are matched by rank.

What a sweep sees is a table of at most ``capacity`` lengths and the runs of
gaps, whose number depends on the capacity alone and not on the number of
documents; the documents stay distributed, and each computes its place from
its class, its rank and the schedule.  The result is exactly that of best-fit
decreasing over all documents at once.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, python_ready
from .tokens import encoder

#: Runs that a schedule may hold when it is broadcast; it has a few for each length.
MAX_RUNS = 2_000_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids and the end id: only longer ones are cut, and then the first piece may be shorter.

    Null or empty text is a document of the end id alone.  Returns
    ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``
    (little-endian unsigned 32-bit).  Rows that repeat a doc_id are packed as
    documents of their own; other columns are ignored.
    """
    python_ready(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut(batches):
        import pyarrow as pa

        encode, end = encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids += end
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (a, b) in enumerate(zip(at, at[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(part), part)[: len(kinds)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def schedule(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rounds of best fit over classes.

    ``counts``: documents of each length.  Returns rows ``(length, first rank,
    first sequence, documents a sequence, offset)`` sorted by length and rank:
    the documents of a length from that rank on (to the next row's) go, so many
    to a sequence, to consecutive sequences from the first, from that offset.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []  # gap sizes that have runs, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap size: a heap of (first sequence, sequences)
    sequences = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(sizes, gap)
                runs[gap] = []
            heapq.heappush(runs[gap], (first, n))

    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = heapq.heappop(runs[gap])
                if not runs[gap]:
                    del runs[gap], sizes[at]
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = gap // length
            used, part = divmod(min(left, each * n), each)
            rows.append((length, rank, first, each, capacity - gap))
            put(gap - each * length, first, used)
            put(gap - part * length, first + used, bool(part))
            put(gap, first + used + bool(part), n - used - bool(part))
            rank += used * each + part
            left -= used * each + part
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """Place every row in a sequence of ``capacity``: adds ``sequence_id`` and ``offset`` to its columns.

    ``length`` must be from 1 to ``capacity``.  Offsets in a sequence are gapless
    from 0.  Ranks in a class follow the rows' other columns, so ties differ in
    nothing; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    python_ready(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pieces = durable(pieces)  # range bounds are sampled from it, so it is read twice
    columns = pieces.columns
    # A class may hold a third of all rows: the other columns spread it over partitions, whose shares are then counted.
    spread = pieces.repartitionByRange(n, length, *[c for c in columns if c != length]).sortWithinPartitions(*([length] + [c for c in columns if c != length]))
    placed = durable(spread.withColumn("__part", F.spark_partition_id()))
    shares = placed.groupBy(length, "__part").agg(F.count("*").alias("n")).orderBy(length, "__part").collect()  # at most partitions + lengths rows, as parts are ranges
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for size, part, some in shares:
        if size is None or not 1 <= size <= capacity:
            raise ValueError(f"a length of {size} is not from 1 to {capacity}")
        before[part, size] = counts.get(size, 0)
        counts[size] = counts.get(size, 0) + some
    plan = schedule(counts, capacity)
    if len(plan) > MAX_RUNS:
        raise RuntimeError(f"a schedule of {len(plan)} runs is not to be broadcast")
    held = spark.sparkContext.broadcast((plan, before))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.drop("__part").schema)

    def place(batches):
        import pyarrow as pa

        plan, before = held.value
        width = np.int64(1) << 40
        keys = plan[:, 0] * width + plan[:, 1] if len(plan) else np.empty(0, np.int64)
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(batch.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = batch.column(batch.schema.get_field_index("__part")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = np.empty(len(sizes), np.int64)
            cut = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(parts) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(sizes)]):
                key = (int(parts[a]), int(sizes[a]))
                start = seen.get(key, before[key])
                rank[a:b] = np.arange(start, start + b - a)
                seen[key] = start + int(b - a)
            row = plan[np.searchsorted(keys, sizes * width + rank, side="right") - 1]
            sequence, slot = np.divmod(rank - row[:, 1], row[:, 3])
            out = [batch.column(k) for k, f in enumerate(batch.schema) if f.name != "__part"]
            names = [f.name for f in batch.schema if f.name != "__part"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(row[:, 2] + sequence), pa.array(row[:, 4] + slot * sizes)], [*names, "sequence_id", "offset"])

    return placed.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack every document: the pieces with their sequence and place (and ids, if asked for)."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences of pieces packed with ids: ``sequence_id, ids, n_tokens, doc_ids``; a sequence is of bounded size."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece", "length"))).alias("p"))
    # hex is a lossless text form, as binary values can't be joined by array_join
    return parts.select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("p.ids", F.hex), "")).alias("ids"),
        F.aggregate("p", F.lit(0), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.col("p.doc_id").alias("doc_ids"),
    )
