"""WARC archives: a writer of record-at-a-time gzip members and a splittable reader.

The writer makes a response record of each payload and a revisit record of each
later copy.  The reader deals byte ranges of the files to tasks; a task looks for
gzip magic in its range, takes a candidate for a member only if a WARC header
decodes from it, and owns the records that start inside its range, which it
reads to their end even beyond it.  So a range needs no index and no record is
read twice or missed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, python_ready, scratch_dir
from .token_files import open_store

#: Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
WARC_VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Copies of smaller payloads are written as responses.
LEAST_REVISIT = 100
SPLIT_BYTES = 8 << 20
_CHUNK = 1 << 20


def mark_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Adds ``payload`` (UTF-8 of html; null: empty), ``digest`` (SHA-256), ``refers_to`` (null for responses).

    Of rows with equal payloads of at least ``least_bytes``, that with the least
    page_id is the response, and each other refers to its page_id; rows that
    repeat the least page_id itself are responses too, since they can't refer to
    themselves, and so are rows with a null page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least_bytes
    copied = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    # in the shared folder, so the join below gets exchanges of its own, which can be split where one payload is hot
    copied = durable(copied.select(F.col("digest").alias("copied"), "least"))
    joined = rows.join(copied, (F.col("digest") == F.col("copied")) & large, "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("least"), F.col("least")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "" if url is None else " ".join(url.split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", "" if page_id is None else page_id),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", len(body)),
    ]
    if refers_to is not None:
        fields[3:3] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {refers_to}')}>"), ("X-Refers-To-Page", refers_to)]
    head = WARC_VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + body + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) to files under ``path``; returns ``file, bytes, records``.

    Null html is an empty payload, a null url an empty target; other columns are
    ignored; an empty table gives no files. Each attempt of a task writes a file of
    its own name; the manifest lists the files of the attempts that counted.
    """
    spark = pages.sparkSession
    python_ready(spark)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, base = open_store(path)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(name, compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                member = record(*row)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

    return durable(mark_revisits(pages, least_bytes).mapInArrow(write, "file string, bytes long, records long"))


class _Window:
    """Bytes of a file from a place on, read as they are needed."""

    def __init__(self, source, at: int, size: int):
        self.source, self.at, self.size, self.held = source, at, size, b""

    def get(self, at: int, least: int) -> memoryview:
        """From ``at`` on, at least so many bytes unless the file ends."""
        if at < self.at or at > self.at + len(self.held):
            self.at, self.held = at, b""
        if at - self.at + least > len(self.held) and self.at + len(self.held) < self.size:
            keep = self.held[at - self.at :]
            self.source.seek(at + len(keep))
            self.at, self.held = at, keep + self.source.read(max(_CHUNK, least - len(keep)))
        return memoryview(self.held)[at - self.at :]


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content of a gzip member that starts here with a WARC header, and its end; None if none starts here.

    What starts as a record and doesn't end as one is damaged and raises ValueError.
    """
    unpack, out, here = zlib.decompressobj(31), [], at
    checked = False
    while not unpack.eof:
        raw = window.get(here, 1)
        try:
            if not len(raw):
                raise zlib.error("the file ends")
            out.append(unpack.decompress(raw))
        except zlib.error as error:
            if checked:
                raise ValueError(f"the record at {at} is damaged: {error}") from error
            return None
        here += len(raw) - len(unpack.unused_data)
        if not checked:
            start = b"".join(out)
            if len(start) >= len(WARC_VERSION):
                if not start.startswith(b"WARC/1."):
                    return None
                checked = True
    content = b"".join(out)
    if not checked:
        return None
    if b"\r\n\r\n" not in content:
        raise ValueError(f"the record at {at} is damaged: its header has no end")
    return content, here


def _begins(window: _Window, at: int) -> bool:
    """Whether a record starts here."""
    try:
        return zlib.decompressobj(31).decompress(bytes(window.get(at, 256)), 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().strip().lower()] = value.decode().strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def records_in(source, size: int, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(place, content)`` of the records that start in ``[begin, end)``.

    Only the first one is searched for.  From there on each must
    start where the last one ended, and one must start where the last of this range
    ends, unless the file ends there: otherwise ValueError, so that no damaged record is
    passed over.
    """
    window, at, sure = _Window(source, begin, size), begin, False
    while at < end:
        if not sure:
            raw = bytes(window.get(at, min(_CHUNK, end - at + 2)))
            found = raw.find(GZIP_MAGIC)
            if found < 0:
                at += max(1, len(raw) - len(GZIP_MAGIC) + 1)
                continue
            at += found
            if at >= end:
                return
        whole = _member(window, at)
        if whole is not None:
            yield at, whole[0]
            at, sure = whole[1], True
        elif sure:
            raise ValueError(f"no record starts at {at}, where one should")
        else:
            at += 1
    if sure and at < size and not _begins(window, at):
        raise ValueError(f"no record starts at {at}, where one should")


def read_warc(spark: SparkSession, files: DataFrame, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the listed files (``file, bytes``), split by byte ranges.

    Returns ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to`` and, if asked for, ``payload`` (null for revisits).  Digest and
    length of a response are computed from what was read; a mismatch with its
    header, a damaged record and a file of another size than listed fail the task.
    """
    python_ready(spark)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(split_bytes).cast("long")))
    ranges = files.select("file", "bytes", starts.alias("begin"))
    n = max(1, ranges.count())

    def read(batches):
        import hashlib

        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)]
        store, _ = open_store(path)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for file, size, begin in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with store.open_input_file(file) as source:
                    if source.size() != size:
                        raise ValueError(f"{file} has {source.size()} bytes, not {size}")
                    for at, content in records_in(source, size, begin, min(size, begin + split_bytes)):
                        fields, block = parse(content)
                        digest, length, kind = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"]), fields["warc-type"]
                        if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != length):
                            raise ValueError(f"{file} at {at}: the payload isn't what its header says")
                        page, refers = fields["x-page-id"], fields.get("x-refers-to-page")
                        rows.append((int(page) if page else None, fields["warc-target-uri"], length, digest, kind, int(refers) if refers else None, block if kind == "response" else None)[: len(kinds)])
                        held += len(block)
                        if len(rows) >= 5000 or held > 1 << 24:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    return ranges.repartition(min(n, 10_000), "file", "begin").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, path: str | None = None, split_bytes: int = SPLIT_BYTES, **options) -> DataFrame:
    """Write the archives (in the shared folder unless ``path`` says where) and read them back."""
    spark = pages.sparkSession
    path = path or scratch_dir(spark, "warc")
    return read_warc(spark, write_warc(pages, path, **options), path, split_bytes)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``read_warc``."""
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["digest", "mark_revisits", "parse", "read_warc", "record", "records_in", "warc_round_trip", "write_warc"]
