from __future__ import annotations

import hashlib
import zlib

import pytest

from foliant.llm.common import work_path
from foliant.llm.warc import op6_warc_roundtrip, read_warc, record_bytes, records_of_range, write_warc

SCHEMA = "page_id long, url string, html string, path string, size long, digest string"
ROWS = [(1, "http://a/", "x" * 1500), (2, None, "x" * 1500), (3, "http://c/\r\nX: y", "x" * 1500), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", "é" * 700), (8, "u", "é" * 700), (8, "u", "é" * 700)]


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "").encode() == data and j is not None]
        first = max(same, default=None)
        revisit = len(data) >= 1000 and sum((o or "").encode() == data for _, _, o in rows) > 1 and first is not None and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [1, 97, 1 << 20])
def test_round_trip(spark, split):
    frame = spark.createDataFrame([(*r, "p", 1, "d") for r in ROWS], SCHEMA)
    archives = write_warc(frame.repartition(3), "page_id", "url", "html", work_path(spark, "warc"))
    rows = read_warc(archives, split_bytes=split).collect()
    found = sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["warc_type"], r["refers_to"]) for r in rows), key=repr)
    assert found == expected(ROWS)
    payloads = {r["record_id"]: bytes(r["payload"]).decode() for r in rows if r["warc_type"] == "response" and r["record_id"]}
    assert payloads[3] == "x" * 1500 and payloads[6] == "" and payloads[8] == "é" * 700


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert read_warc(write_warc(frame, "page_id", "url", "html", work_path(spark, "warc"))).isEmpty()


def test_magic_inside_a_record_is_no_record(tmp_path):
    def member(data: bytes, level: int) -> bytes:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()

    inner = member(record_bytes(99, "u", b"inner", hashlib.sha1(b"inner").hexdigest(), None), 9)
    payload = b"text" * 5 + inner + b"more" * 500
    # Stored blocks keep the inner record's bytes as they are.
    outer = member(record_bytes(1, "u", payload, hashlib.sha1(payload).hexdigest(), None), 0)
    last = member(record_bytes(2, "u", b"end", hashlib.sha1(b"end").hexdigest(), None), 6)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(outer + last)
    size = path.stat().st_size
    found = [r["record_id"] for at in range(0, size, 50) for r in records_of_range(str(path), at, min(at + 50, size))]
    assert sorted(found) == [1, 2]


def test_query(spark, small):
    rows = op6_warc_roundtrip(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count()
