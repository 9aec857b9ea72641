"""Token-id files: independent zstandard frames, a trailing seek table and per-frame checksums.

A file is a run of zstandard frames, each with whole documents, then two
skippable frames that any zstandard reader passes over::

    frame*                          little-endian unsigned 32-bit ids, content checksum on
    skippable frame 0x184D2A5D      per document: doc_id i64, is_null u8, frame u32, ids u32
    skippable frame 0x184D2A5E      the public seekable-format table: per frame compressed size u32,
                                    decompressed size u32, checksum u32 (low half of XXH64 of the content);
                                    then number of frames u32, descriptor u8 (0x80), magic 0x8F92EAB1

A reader takes the end of the file, finds the documents it was asked for and
decompresses only their frames.  Each attempt of a task writes a file of its own
name, and the manifest lists the files of the attempts that counted; what a lost or a
second attempt left is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, python_ready, scratch_dir
from .tokens import encoder

_INDEX, _TABLE, _END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("ids", "<u4")])
FRAME_BYTES = 1 << 20


def open_store(path: str):
    """The store of a path and the path within it: local, or one that pyarrow reaches by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes documents, in the order given, to an open binary file."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.frame_bytes, self.docs, self.frames, self.held, self.size = out, frame_bytes, [], [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        import xxhash

        if self.held:
            raw = b"".join(self.held)
            packed = self.compressor.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        docs = np.array(self.docs, dtype=_DOC).tobytes()
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _END)
        for magic, body in ((_INDEX, struct.pack("<Q", len(self.docs)) + docs), (_TABLE, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)


class FrameReader:
    """Reads an open, seekable binary file; ``read(rows)`` decompresses only the frames of those documents."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        source.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _END:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - 12 * frames - 8
        source.seek(table_at)
        body = source.read(8 + 12 * frames)
        if struct.unpack_from("<I", body)[0] != _TABLE:
            raise ValueError("the seek table doesn't begin where it should")
        self.frames = [struct.unpack_from("<III", body, 8 + 12 * k) for k in range(frames)]
        self.starts = np.cumsum([0, *(x[0] for x in self.frames)])
        source.seek(int(self.starts[-1]))
        raw = source.read(table_at - int(self.starts[-1]))
        magic, length, n = struct.unpack_from("<IIQ", raw)
        if magic != _INDEX or len(raw) != length + 8:
            raise ValueError("the index of documents is damaged")
        self.docs = np.frombuffer(raw, dtype=_DOC, count=n, offset=16)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, plain, check = self.frames[k]
        self.source.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain) if plain else b""
        if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def read(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """``(doc_id, ids)`` of the documents at these places of the index (all by default), in order."""
        before = np.cumsum(self.docs["ids"], dtype=np.int64) - self.docs["ids"]
        first = np.searchsorted(self.docs["frame"], np.arange(len(self.frames) + 1))
        held, raw = -1, b""
        for k in range(len(self.docs)) if rows is None else rows:
            doc_id, null, frame, n = self.docs[k].tolist()
            if n and frame != held:
                held, raw = frame, self.frame(frame)
            at = int(before[k] - before[first[frame]]) * 4 if n else 0
            yield None if null else doc_id, raw[at : at + 4 * n] if n else b""


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, files: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encode ``text`` of every row and write the ids under ``path``, in ascending ``doc_id`` order over all files.

    Null or empty text gives only the end id; rows that repeat a doc_id stay
    side by side (by text); a null doc_id comes first; other columns are
    ignored; an empty table gives no files.  Returns a durable manifest
    ``file_no, file, n_docs, n_ids``, where file_no is in doc_id order.
    """
    spark = docs.sparkSession
    python_ready(spark)
    wide = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = wide.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        no, out, writer, n_docs, n_ids = TaskContext.get().partitionId(), None, None, 0, 0
        store, base = open_store(path)
        name, end = f"{base}/part-{no:06d}-{uuid.uuid4().hex}.ids", struct.pack("<I", end_id)
        encode = encoder(tokenizer).encode
        for batch in batches:
            if writer is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(name, compression=None)
                writer = FrameWriter(out, frame_bytes)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                writer.add(doc_id, ids + end)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    return durable(ordered.mapInArrow(write, "file_no int, file string, n_docs long, n_ids long"))


def read_token_files(spark: SparkSession, manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (binary).

    A task reads a file; ``start`` counts the ids of all documents before.  The
    manifest has a row for each file, written by one task each, so its running
    sum is small whatever the texts hold.
    """
    python_ready(spark)
    rows = sorted(manifest.select("file_no", "file", "n_ids").collect())
    starts = np.cumsum([0, *(r.n_ids for r in rows)]).tolist()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    listed = spark.createDataFrame([(r.file_no, r.file, s) for r, s in zip(rows, starts)], "file_no int, file string, start long")

    def read(batches):
        import pyarrow as pa

        store, _ = open_store(path)
        kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]
        for batch in batches:
            for file, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_file(file) as source:
                    held, size = [], 0
                    for doc_id, ids in FrameReader(source).read():
                        held.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), ids)[: len(kinds)])
                        start, size = start + len(ids) // 4, size + len(ids)
                        if len(held) >= 5000 or size > 1 << 25:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names)

    return listed.repartition(max(1, len(rows)), "file_no").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the files (in the shared folder unless ``path`` says where) and read them back."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "token-files")
    return read_token_files(spark, write_token_files(docs, path, tokenizer, **options), path)
