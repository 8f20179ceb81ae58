"""WARC archives: a writer with revisit records and a splittable reader.

Writing: of equal payloads of at least ``revisit_bytes`` bytes the record with
the largest id is a ``response`` and the others are ``revisit`` records that
refer to it.  Each task writes its records as gzip members of one archive to
the shared folder under a temporary name and renames it, so a task that runs
again replaces its own archive and a lost executor costs no record.

Reading: the archives' byte ranges are dealt out as tasks.  A task scans its
range for the gzip magic, takes a candidate only if it decodes to a WARC header
and a further member or the file's end follows it, and then owns every record
that starts inside the range, reading past the range's end where its last
record does.  Ranges of any size give each record exactly once.

Defined results: a null payload is empty; a null id is written as ``-`` and
read as null; rows that repeat an id are records of their own (repeats of the
largest id are all responses); payloads of any length are written and read
whole, a record at a time; empty tables give no archive and no record; only the
id, URI and payload columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import table, with_text_batches, work_path, written

REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
GZIP_LEVEL = 6
_CHUNK = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"

ARCHIVE_SCHEMA = "path string, size long, records long"
RECORD_SCHEMA = (
    "path string, position long, warc_type string, record_id long, target_uri string, refers_to long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:/*", "/", uri))


def _urn(record_id: int | None) -> str:
    return f"<urn:foliant:record:{'-' if record_id is None else record_id}>"


def _id_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:foliant:record:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _clean(value: str) -> str:
    """A header value may hold no line break."""
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(record_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(record_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, revisit_bytes: int) -> DataFrame:
    """(record_id, uri, payload, digest, refers_to): which record refers to which."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.col(uri_col).cast("string").alias("uri"),
        payload.alias("payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
    )
    # Only digests that occur more than once are kept: a third of all rows may share one of them.
    repeated = written(
        rows.where(F.octet_length("payload") >= revisit_bytes)
        .groupBy("digest")
        .agg(F.max("record_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id"),
        "payload-digests",
    )
    return rows.join(repeated, "digest", "left").select(
        "record_id",
        "uri",
        "payload",
        "digest",
        F.when(F.col("first_id") != F.coalesce("record_id", F.lit(-(2**63))), F.col("first_id")).alias("refers_to"),
    )


def write_warc(
    pages: DataFrame,
    id_col: str,
    uri_col: str,
    payload_col: str,
    folder: str,
    revisit_bytes: int = REVISIT_BYTES,
    level: int = GZIP_LEVEL,
) -> DataFrame:
    """Write one record per row to ``folder``; returns the table of archives (path, size, records)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}.warc.gz"
        system, path = _file_system(name)
        hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        out = None
        size = records = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(hidden, compression=None)
                own, first = (None if pd.isna(x) else int(x) for x in (row.record_id, row.refers_to))
                data = record_bytes(own, row.uri, row.payload.encode(), row.digest, first)
                packed = _member(data, level)
                out.write(packed)
                size, records = size + len(packed), records + 1
        if out is not None:
            out.close()
            if system.get_file_info(path).type != arrow_fs.FileType.NotFound:  # of this task's earlier run; not all file systems replace
                system.delete_file(path)
            system.move(hidden, path)
            yield pd.DataFrame({"path": [name], "size": [size], "records": [records]})

    rows = with_revisits(with_text_batches(pages), id_col, uri_col, payload_col, revisit_bytes)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("record_id", "refers_to")})  # exact beside nulls
    return written(rows.mapInPandas(write, ARCHIVE_SCHEMA), "warc-archives")


class _Member:
    """A gzip member read from a position of a file, piece by piece."""

    def __init__(self, source, position: int):
        self.source, self.position = source, position

    def read(self) -> tuple[bytes, int]:
        """Its content and where it ends."""
        return self._read(None)

    def begins(self, least: int = 5) -> bytes:
        """The first bytes of its content."""
        return self._read(least)[0]

    def _read(self, least: int | None) -> tuple[bytes, int]:
        unpack, at, parts, size = zlib.decompressobj(31), self.position, [], 0
        while not unpack.eof and (least is None or size < least):
            chunk = self.source.read_at(_CHUNK if least is None else 512, at)
            if not chunk:
                raise EOFError("the archive ends inside a record")
            at += len(chunk)
            parts.append(unpack.decompress(chunk))
            size += len(parts[-1])
        return b"".join(parts), at - len(unpack.unused_data)


class _File:
    def __init__(self, uri: str):
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read_at(self, n: int, at: int) -> bytes:
        return self.file.read_at(min(n, max(0, self.size - at)), at) if at < self.size else b""


def _starts_record(source: _File, at: int) -> bool:
    """True if a member that decodes to a WARC header begins there."""
    if source.read_at(3, at) != _MAGIC:
        return False
    try:
        return _Member(source, at).begins().startswith(b"WARC/")
    except (zlib.error, EOFError):
        return False


def first_record(source: _File, start: int, end: int) -> int | None:
    """The first position in [start, end) where a record begins."""
    at, data = start, b""
    while at < end:
        data = source.read_at(_CHUNK, at)
        found = data.find(_MAGIC)
        while found >= 0 and at + found < end:
            here = at + found
            if _starts_record(source, here):
                try:
                    _, after = _Member(source, here).read()
                    if after >= source.size or _starts_record(source, after):
                        return here
                except (zlib.error, EOFError):
                    pass
            found = data.find(_MAGIC, found + 1)
        if len(data) < _CHUNK:
            return None
        at += len(data) - 2  # a magic may lie across two pieces
    return None


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields.get("content-length", 0))]
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "revisit":
        payload, size = None, int(fields.get("x-payload-length", 0))
    else:
        size = len(payload)
        if digest and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")
    return {
        "warc_type": fields.get("warc-type"),
        "record_id": _id_of(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": _id_of(fields.get("warc-refers-to")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


def records_of_range(uri: str, start: int, end: int) -> Iterator[dict]:
    """The records of an archive that start in [start, end)."""
    source = _File(uri)
    at = first_record(source, start, min(end, source.size))
    while at is not None and at < min(end, source.size):
        data, after = _Member(source, at).read()
        yield {"path": uri, "position": at, **parse_record(data)}
        at = after


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives (path, size), read in byte ranges of ``split_bytes``."""
    ranges = archives.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                kept, size = [], 0
                for record in records_of_range(row.path, row.start, row.start + split_bytes):
                    size += record["payload_bytes"] if payloads else 200
                    if not payloads:
                        record["payload"] = None
                    kept.append(record)
                    if size > 16 << 20:
                        yield _frame(kept, names)
                        kept, size = [], 0
                if kept:
                    yield _frame(kept, names)

    tasks = ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4)
    return tasks.mapInPandas(read, RECORD_SCHEMA)


def _frame(records: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(records, columns=names)
    for name in ("record_id", "refers_to"):
        out[name] = pd.array([r[name] for r in records], dtype="Int64")
    return out


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = write_warc(pages, "page_id", "url", "html", work_path(spark, "warc"))
    return read_warc(archives, payloads=False).select(
        F.col("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        "refers_to",
    )


QUERIES = {"op6_warc_roundtrip": op6_warc_roundtrip}

ORACLES = {
    "op6_warc_roundtrip": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first_id <> page_id THEN first_id END AS refers_to
FROM g
"""
}
