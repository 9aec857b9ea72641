"""Substring deduplication by digests of passages.

A unit is a passage of ``least_words`` words in a row, wherever it begins and however it is
broken into lines.  Words are ``[^\\x20\\x09-\\x0D]+``, normalised (A-Z in lower case, without ASCII
punctuation).  Digests are grouped globally; of the occurrences of a passage the
earliest one, ranked by doc_id and then by place, is kept, and the words of all others are
removed.  So what goes is exactly the words inside a passage of at least ``least_words``
words that stands earlier, in another document or in the same one, and the spans of what
goes are kept as offsets in the original text, in code points.

Digests of all passages would be a row for each word of the corpus.  So documents are
first compared by anchors: of the ``least_words - ANCHOR + 1`` runs of ``ANCHOR`` words
within a passage the one with the least digest.  Equal passages have equal anchors, neighbours
mostly have the same one (about a row for sixteen words), and only passages
whose anchor occurs in two texts, or twice in one, are digested.  Equal texts
are one text from the start; of their rows all but the least doc_id lose all words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, fresh, own_exchange, python_ready, release, stored

LEAST_WORDS = 50
#: Words of the runs that anchors are chosen from; half of a passage if that is less.
ANCHOR = 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PUNCTUATION = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_SEED = 42
_DICE = np.random.Generator(np.random.PCG64(_SEED))
_ODD = (_DICE.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)).tolist()


def word_hashes(text: str) -> np.ndarray:
    """A hash of each normalised word (one without letters or digits counts as a word too)."""
    import xxhash

    words, digest = text.encode().translate(_LOWER).split(), xxhash.xxh64_intdigest
    known = {x: digest(x.translate(None, _PUNCTUATION), _SEED) for x in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def run_hashes(words: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """A hash of every run of ``length`` words: a polynomial modulo 2^64, mixed."""
    odd = _ODD[kind]
    sums = words[length - 1 :].copy() if len(words) >= length else words[:0].copy()
    power = 1
    for k in range(length - 2, -1, -1):
        power = power * odd % (1 << 64)
        sums += words[k : k + len(sums)] * np.uint64(power)
    return _mixed(sums)


def anchors(words: np.ndarray, least_words: int) -> np.ndarray:
    """The anchor of each passage: the least hash of the runs within it."""
    run = min(ANCHOR, max(1, least_words // 2))
    least = run_hashes(words, run)
    width, reach = least_words - run + 1, 1
    while reach < width:  # least over the next ``reach`` runs
        step = min(reach, width - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return least


def _anchor_rows(texts: DataFrame, least_words: int) -> DataFrame:
    """``g, t, twice``: the anchors of each text; ``twice`` if a passage of that anchor stands there twice."""
    python_ready(texts.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            gs, ts, twos = [], [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text) if text else ()
                if len(words) < least_words:
                    continue
                least = anchors(words, least_words)
                _, first, count = np.unique(run_hashes(words, least_words), return_index=True, return_counts=True)
                own = np.unique(least)
                gs.append(own)
                ts.append(np.full(len(own), t, np.int64))
                twos.append(np.isin(own, least[first[count > 1]]))
            if gs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gs).view(np.int64)), pa.array(np.concatenate(ts)), pa.array(np.concatenate(twos))], ["g", "t", "twice"])

    return texts.mapInArrow(work, "g long, t long, twice boolean")


def _passages(texts: DataFrame, least_words: int) -> DataFrame:
    """``h, c, d, t, at``: digest (96 bits) and first word of the passages whose anchor is in ``gs``."""
    python_ready(texts.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            ds, ts, texts, gs = batch.columns
            for d, t, text, wanted in zip(ds.to_pylist(), ts.to_pylist(), texts.to_pylist(), gs):
                words = word_hashes(text)
                at = np.flatnonzero(np.isin(anchors(words, least_words), wanted.values.to_numpy().view(np.uint64)))
                h, c = (run_hashes(words, least_words, kind)[at] for kind in (0, 1))
                n = len(at)
                columns = [pa.array(h.view(np.int64)), pa.array((c >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array([d] * n, pa.int64()), pa.array(np.full(n, t, np.int64)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c", "d", "t", "at"])

    return texts.select("d", "t", "text", "gs").mapInArrow(work, "h long, c int, d long, t long, at int")


def removed_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """What goes: ``d, t, starts`` (places of first words of repeated passages), ``whole`` (an equal text has a lesser doc_id)."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit("second"), text).alias("u")).where("text is not null")
    place = F.struct("d")
    copied = rows.groupBy("t", "u").agg(F.min(place).alias("least"), F.max(place).alias("most")).where(~F.col("least").eqNullSafe(F.col("most")))
    copied = durable(copied.select("t", "u", F.col("least.d").alias("r")))

    found = stored(_anchor_rows(rows.select("t", "text"), least_words), "anchors")
    shared = found.groupBy("g").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.bool_or("twice").alias("twice")).where("lo <> hi or twice")
    shared = stored(shared.select("g"), "shared-anchors")
    wanted = found.join(shared.select(own_exchange("g")), "g", "left_semi").groupBy("t").agg(F.collect_set("g").alias("gs"))
    firsts = copied.groupBy("t").agg(F.collect_list(F.struct("u", "r")).alias("copies"))
    wanted = stored(wanted.join(firsts, "t", "left"), "wanted-texts")
    discard(found, shared)
    # only the row of the least doc_id of equal texts
    own = F.filter("copies", lambda x: x["u"] == F.col("u"))
    texts = rows.join(wanted.select(own_exchange("t"), "gs", "copies"), "t").where(F.col("copies").isNull() | (F.size(own) == 0) | F.exists(own, lambda x: x["r"].eqNullSafe(F.col("d"))))
    passages = stored(_passages(texts, least_words), "passages")
    discard(wanted)
    release(docs.sparkSession)

    keepers = passages.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "at")).alias("keeper")).where("n > 1")
    keepers = stored(keepers.select("h", "c", "keeper"), "kept-passages")  # then the join has exchanges of its own, which can be split where one passage is hot
    gone = passages.join(keepers, ["h", "c"]).where(~F.struct("d", "t", "at").eqNullSafe(F.col("keeper")))
    gone = stored(gone.groupBy("d", "t").agg(F.collect_set("at").alias("starts")).withColumn("whole", F.lit(False)), "repeated-passages")
    discard(passages, keepers)
    release(docs.sparkSession)
    whole = rows.select("d", "t", "u").join(copied, ["t", "u"]).where(~F.col("d").eqNullSafe(F.col("r"))).select("d", "t").distinct()
    return gone.unionByName(whole.withColumn("starts", F.lit(None).cast("array<int>")).withColumn("whole", F.lit(True)))


def cut_out(text: str, starts, whole: bool, least_words: int) -> tuple[str, int, str]:
    """The text without the removed runs of words, their number, and their spans."""
    words = [m.span() for m in _WORD.finditer(text)]
    gone = np.zeros(len(words) + 1, np.int64)
    if whole:
        gone[: len(words)] = len(words) >= least_words
    else:
        np.add.at(gone, starts, 1)
        np.add.at(gone, np.asarray(starts) + least_words, -1)
        gone = np.cumsum(gone) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone[: len(words)].astype(np.int8), [0]))))
    spans = [(words[a][0], words[b - 1][1]) for a, b in edges.reshape(-1, 2).tolist()]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]]), len(spans), ",".join(f"{a}:{b}" for a, b in spans)


def dedup_substrings(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the words of passages that stand earlier.

    Adds ``n_removed`` (runs of words that went) and ``removed`` (``start:end`` of each in the original
    text, end exclusive, comma-joined); white space around a run stays.  Null and empty texts, and texts of
    fewer words than ``least_words``, stay as they are; a text may become white space only; ties go to the least
    doc_id (null first), then place; rows that repeat doc_id and text are one document and
    are treated alike; other columns pass through; an empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    names = docs.columns
    row, text0, starts, whole, cut = (fresh(names, x) for x in ("row0", "text0", "starts0", "whole0", "cut0"))
    gone = removed_passages(docs, least_words).withColumnRenamed("starts", starts).withColumnRenamed("whole", whole)

    @F.pandas_udf("text string, n_removed long, removed string")
    def cleaned(texts, places, copies):
        import pandas as pd

        made = [(None, 0, "") if text is None else cut_out(text, () if at is None else at, bool(copy), least_words) for text, at, copy in zip(texts, places, copies)]
        return pd.DataFrame(made, columns=["text", "n_removed", "removed"])

    text = F.col("text").cast("string")
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col("doc_id").cast("long").alias("d0"), text.alias(text0), F.xxhash64(text).alias("t0"))
    joined = key.join(gone, key["d0"].eqNullSafe(gone["d"]) & (key["t0"] == gone["t"]), "left")
    joined = joined.withColumn(cut, cleaned(F.when(F.col(whole).isNotNull(), F.col(text0)), F.col(starts), F.coalesce(whole, F.lit(False))))
    text = F.when(F.col(whole).isNull(), F.col(text0)).otherwise(F.col(cut).getField("text"))
    out = [text.alias("text") if c.lower() == "text" else F.col(row).getField(c).alias(c) for c in names]
    return joined.select(*out, F.col(cut).getField("n_removed").alias(fresh(names, "n_removed")), F.col(cut).getField("removed").alias(fresh(names, "removed")))


def digest(cleaned: DataFrame) -> DataFrame:
    """``doc_id, text, n_removed, removed``."""
    return cleaned.select("doc_id", "text", "n_removed", "removed")
