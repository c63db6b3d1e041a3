"""Archives of others, damaged members, wrong counts."""

import gzip
import uuid

import pytest

from saccade.llm import warc


def member(kind, headers, body):
    head = "\r\n".join(["WARC/1.0", f"warc-TYPE: {kind}", *headers, f"content-length:{len(body)}"])
    return gzip.compress(head.encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def foreign():
    ids = [f"<urn:uuid:{uuid.UUID(int=i)}>" for i in range(6)]
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 5\r\n\r\nhello"
    return ids, [
        member("warcinfo", [f"WARC-Record-ID: {ids[0]}", "Content-Type: application/warc-fields"], b"software: x\r\n\r\nmore"),
        member("request", [f"warc-record-id: {ids[1]}", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member("response", [f"WARC-RECORD-ID: {ids[2]}", "CONTENT-TYPE: application/http; msgtype=response", "WARC-Target-URI:   http://a/"], http),
        member("revisit", [f"WARC-Record-ID: {ids[3]}", "Content-Type: application/http; msgtype=response", f"WARC-Refers-To: {ids[2]}", "WARC-Payload-Digest: sha1:ABC"], http[:-5]),
        member("resource", [f"WARC-Record-ID: {ids[4]}", "Content-Type: text/plain"], b"a\r\n\r\nb"),
    ]


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_foreign_archive(spark, tmp_path, split):
    ids, members = foreign()
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    folder = f"file://{tmp_path}"
    got = sorted(warc.read_archives(warc.archives(spark, folder), folder, split).collect(), key=lambda r: r.record_id or "")
    assert [r.error for r in got] == [None] * 5
    assert [(r.record_id, r.record_type) for r in got] == list(zip(ids, ["warcinfo", "request", "response", "revisit", "resource"]))
    assert [r.payload and bytes(r.payload) for r in got] == [b"software: x\r\n\r\nmore", b"", b"hello", None, b"a\r\n\r\nb"]
    assert got[2].url == "http://a/" and got[2].payload_digest == warc.payload_digest(b"hello") and got[3].payload_digest == "ABC"
    assert got[3].refers_to_id == ids[2] and got[3].payload_bytes == 5 and all(r.page_id is None and r.refers_to is None for r in got)


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_damaged_members_are_rows(spark, tmp_path, split):
    ids, members = foreign()
    cut = members[1][: len(members[1]) // 2]
    broken = bytearray(members[3])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + cut + members[2] + bytes(broken) + members[4] + b"tail"
    (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "junk.warc.gz").write_bytes(b"no archive at all")
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort") + gzip.compress(b"WARC/1.0\r\nno type\r\n\r\n"))
    folder = f"file://{tmp_path}"
    manifest = warc.archives(spark, folder).selectExpr("path", "bytes", "case when path = 'x.warc.gz' then 5L end as records")
    got = warc.read_archives(manifest, folder, split).collect()
    assert {r.record_id for r in got if r.error is None} == {ids[0], ids[2], ids[4]}
    a, b = len(members[0]), len(members[0] + cut)
    c = b + len(members[2])
    errors = sorted((r.path, r.error) for r in got if r.error)
    assert errors == sorted([
        ("x.warc.gz", f"bytes {a} to {b} hold no whole record"),
        ("x.warc.gz", f"bytes {c} to {c + len(broken)} hold no whole record"),
        ("x.warc.gz", f"bytes {len(data) - 4} to {len(data)} hold no whole record"),
        ("x.warc.gz", "3 records, 5 were written"),
        ("junk.warc.gz", "bytes 0 to 17 hold no whole record"),
        ("bad.warc.gz", "record at byte 0: Content-Length '99' with a block of 5 bytes"),
        ("bad.warc.gz", next(e for p, e in errors if p == "bad.warc.gz" and "no WARC-Type" in e)),
    ])
