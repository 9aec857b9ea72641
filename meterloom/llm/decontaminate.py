"""Benchmark decontamination by an FM-index for each shard of the training text.

A shard is a run of documents that one task has read.  Its words become
symbols: those of the test items' vocabulary.  Any other word can't be part
of an occurrence, so it only separates, and runs of known words shorter than the
shortest phrase are left out (no occurrence fits there).  All phrases are then
searched backward at once through wavelet-matrix ranks, their occurrences are
located by sampled suffix positions, and the words that they cover are merged to
removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, python_ready
from .fm_index import FMIndex

#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z; in UTF-8 every byte from 0x80 on belongs to one.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a shard, and phrases of a block of test items.
SHARD_WORDS = 2_000_000
BLOCK_PHRASES = 200_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Phrases:
    """The windows of a block of test items, as symbols of the block's vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for k in range(max(1, len(symbols) - window + 1) if symbols else 0):
                windows.setdefault(tuple(symbols[k : k + window]), set()).add(item)
        self.items = [sorted(x, key=str) for x in windows.values()]
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.symbols = np.zeros((len(windows), max(self.lengths, default=1)), np.int64)
        for row, x in zip(self.symbols, windows):
            row[: len(x)] = x


def scan_shard(words: list[list[bytes]], phrases: Phrases) -> Iterator[tuple[np.ndarray, list]]:
    """For each document: which of its words are hit, and the items with windows in it."""
    sizes = [len(x) for x in words]
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    get = phrases.vocabulary.get
    symbols = np.fromiter((get(w, 0) for x in words for w in x), np.int64, total)
    edges = np.zeros(total + 1, bool)
    edges[ends] = True
    edges[0] = True
    # runs of known words within a document, as [begin, end)
    known = symbols > 0
    begins = np.flatnonzero(known & (edges[:-1] | ~np.concatenate(([False], known[:-1]))))
    stops = np.flatnonzero(known & (edges[1:] | ~np.concatenate((known[1:], [False])))) + 1
    long = stops - begins >= (phrases.lengths.min() if len(phrases.lengths) else total + 1)
    begins, stops = begins[long], stops[long]
    hit = np.zeros(total + 1, np.int64)
    found: list[set] = [set() for _ in words]
    if len(begins):
        lengths = stops - begins
        # each run and a separator of its own after it, all separators less than any word
        at = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        origin = np.full(len(text), -1, np.int64)
        inside = np.ones(len(text), bool)
        inside[at + lengths] = False
        origin[inside] = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        text[inside] = symbols[origin[inside]]
        index = FMIndex(text)
        lo, hi = index.search(phrases.symbols, phrases.lengths)
        which = np.flatnonzero(hi > lo)
        n = (hi - lo)[which]
        phrase = np.repeat(which, n)
        rows = np.repeat(lo[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        place = origin[index.locate(rows)]
        hit += np.bincount(place, minlength=total + 1) - np.bincount(place + phrases.lengths[phrase], minlength=total + 1)
        doc = np.searchsorted(ends, place, side="right")
        for d, p in np.unique(np.stack((doc, phrase), 1), axis=0).tolist():
            found[d].update(phrases.items[p])
    covered = np.cumsum(hit[:-1]) > 0
    for k, x in enumerate(words):
        yield covered[int(ends[k]) - len(x) : int(ends[k])], sorted(found[k], key=str)


def spans_of(flags: np.ndarray) -> list[list[int]]:
    """Merged ``[first word, word after the last]`` spans."""
    steps = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(steps > 0), np.flatnonzero(steps < 0)), 1).tolist()


def _blocks(benchmark: DataFrame, window: int, block_phrases: int) -> Iterator[Phrases]:
    """Test items in blocks of bounded size, read partition by partition."""
    held, size = [], 0
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").orderBy(F.col("item_id").cast("string"), "text")
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += max(1, len(words_of(text)))
        if size >= block_phrases:
            yield Phrases(held, window)
            held, size = [], 0
    if held:
        yield Phrases(held, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_phrases: int = BLOCK_PHRASES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Words of ``docs`` inside any occurrence of a test item's window of ``window`` words (all its words, if fewer).

    Returns a row for each document: ``doc_id, n_words, n_hit, items`` (item_ids
    as strings, sorted as such) and ``spans`` (word spans to remove, end
    exclusive).  Null and empty texts have no words; an empty benchmark hits
    nothing; items without words or with a null id hit words but aren't listed;
    rows that repeat a doc_id each get a row; other columns are ignored.  Test
    items beyond a block's bound are searched in further passes, whose spans are
    merged, so what is broadcast stays bounded.
    """
    spark = docs.sparkSession
    python_ready(spark)
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(held):
        def shards(batches):
            import pyarrow as pa

            def flush(ids, words):
                out = [(i, len(x), int(flags.sum()), [str(y) for y in items if y is not None], spans_of(flags)) for i, x, (flags, items) in zip(ids, words, scan_shard(words, held.value))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "n_words", "n_hit", "items", "spans"])

            ids, words, size = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids.append(doc_id)
                    words.append(words_of(text))
                    size += len(words[-1])
                    if size >= shard_words or len(ids) >= 20_000:
                        yield flush(ids, words)
                        ids, words, size = [], [], 0
            if ids:
                yield flush(ids, words)

        return shards

    blocks = _blocks(benchmark, window, block_phrases)
    first = next(blocks, None) or Phrases([], window)
    second = next(blocks, None)
    if second is None:
        return texts.mapInArrow(scan(spark.sparkContext.broadcast(first)), schema)
    texts = durable(texts)  # every pass then sees the rows in one order
    passes = []
    for block in chain([first, second], blocks):
        held = spark.sparkContext.broadcast(block)
        passes.append(durable(texts.mapInArrow(scan(held), schema).withColumn("row", F.monotonically_increasing_id())))
        held.destroy()
    return _merge(passes)


def _merge(passes: list[DataFrame]) -> DataFrame:
    """Union of what several passes found, by row."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    rows = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
    )
    merged = F.aggregate(
        "all",
        F.array().cast("array<array<bigint>>"),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(F.element_at(out, -1), 2) >= s[0]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(F.element_at(out, -1)[0], F.greatest(F.element_at(out, -1)[1], s[1]))))).otherwise(F.concat(out, F.array(s))),
    )
    rows = rows.withColumn("spans", F.when(F.size("all") > 0, merged).otherwise(F.col("all")))
    return rows.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]).alias("n_hit"), "items", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_contamination``."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows whose text holds a test item's window, whatever their doc_id."""
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    name = fresh(docs.columns, "t0")
    found = find_contamination(docs.select(text.alias("doc_id"), "text"), benchmark, window)
    found = durable(found.where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(found, text == found[name], "left_anti").select(docs.columns)

