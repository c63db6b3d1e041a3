"""WARC archives: a writer with identical-payload revisits and a splittable reader.

Archives are sequences of gzip members, one record each. A task gets a byte range, looks for the gzip magic in it and takes
as candidates what decodes as a whole member with a WARC header, reading past the range's end for the last one. A record may
itself hold stored gzip members, which look the same from inside a range. So the candidates of an archive (16 bytes each) are chained: a
member begins where the one before ends, and what lies inside a member is none. Then each task reads the members that start in
its range. So archives split anywhere, and each record is read once. Our writer ends an archive at ``ARCHIVE_BYTES``; the chain
of an archive is bounded by its length.

Archive files are written and read by the tasks through ``pyarrow.fs``, in the shared folder. A file has a name of its own
per attempt; only files in the manifest, itself a table of the successful tasks, are read, so lost or repeated tasks do no harm.

Foreign archives (archives()) are read too: record types of all kinds, ids as text, field names in any case, blocks that are no HTTP message.
What lies between members and is none (a member that was cut or damaged), a record without a sensible head and a number of records that
differs from the manifest's are rows with an error. Archives are compressed by record, as the format asks for.

Edge cases: null html is an empty payload, null url gives no WARC-Target-URI; a null page_id is never referred to and is a
response; rows with the smallest page_id of equal payloads are all responses; no pages, no archives, no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
PAGE_URN = "urn:x-page:"
ARCHIVE_BYTES = 1 << 30
_START = b"WARC/"
_PROBE = 1 << 12
_BLOCK = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit without body whose HTTP header keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE_URN}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_referents(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the page that holds the payload, for pages that repeat one of at least least_bytes."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    big = F.octet_length("html") >= least_bytes
    repeated = rows.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(repeated, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(big & (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes rows (page_id, url, html, refers_to) to archives in folder; returns the manifest: path, bytes, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, records, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256).to_pydict()
                for page, url, html, first in zip(part["page_id"], part["url"], part["html"], part["refers_to"], strict=True):
                    if out is not None and size >= ARCHIVE_BYTES:
                        yield close()
                        out = None
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        name, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(page, url, (html or "").encode(), first)
                    out.write(member)
                    records, size = records + 1, size + len(member)
        if out is not None:
            yield close()

    return materialize(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "manifest")


class _Blocks:
    """A file read in blocks, of which the last one is kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, position: int) -> memoryview:
        """Bytes from position on: at least one, unless the file ends there; no more than a block."""
        if not self.start <= position < self.start + len(self.data):
            self.file.seek(position)
            self.start, self.data = position, self.file.read(min(_BLOCK, max(0, self.size - position)))
        return memoryview(self.data)[position - self.start :]


def _member(blocks: _Blocks, start: int, keep: bool) -> tuple[int, bytes] | None:
    """(end, record) of the gzip member at start, if it is one and holds a WARC record; the record is empty without keep."""
    unpacker, parts, head, at = zlib.decompressobj(31), [], b"", start
    try:
        while not unpacker.eof:
            piece = blocks.at(at)
            if not piece:
                return None
            piece = piece[: _PROBE if at == start else _BLOCK]
            raw = unpacker.decompress(piece)
            at += len(piece) - len(unpacker.unused_data)
            if len(head) < len(_START):
                head += raw[: len(_START)]
                if not head.startswith(_START[: len(head)]):
                    return None
            if keep:
                parts.append(raw)
    except zlib.error:  # it looked like a member and is none
        return None
    return (at, b"".join(parts)) if head.startswith(_START) else None


def candidates(file, size: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of everything in [start, end) of an archive that decodes as a member with a record, nested ones too."""
    blocks, probe, at = _Blocks(file, size), _Blocks(file, size), start
    while at < end:
        block = bytes(blocks.at(at)[: end - at + len(MAGIC) - 1])
        found = block.find(MAGIC)
        while found >= 0:
            if (got := _member(probe, at + found, keep=False)) is not None:
                yield at + found, got[0]
            found = block.find(MAGIC, found + 1)
        # the magic may lie across the end of the block
        at += max(1, len(block) - len(MAGIC) + 1)


def records_at(file, size: int, starts: list[int]) -> Iterator[bytes]:
    """The decompressed records of the members at starts."""
    blocks = _Blocks(file, size)
    for start in starts:
        yield _member(blocks, start, keep=True)[1]


def chain(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which candidates of an archive (in order) are its members: each begins where the one before ends, or next after junk."""
    own, at = np.zeros(len(starts), bool), 0
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if start >= at:
            own[i], at = True, end
    return own


def parse_record(raw: bytes) -> dict:
    """Fields of one record of any type; field names in any case. ValueError if its head makes no sense."""
    head, blank, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    if not blank or "warc-type" not in fields:
        raise ValueError("no WARC-Type")
    length = fields.get("content-length", "")
    if not length.isdecimal() or len(body) < int(length):
        raise ValueError(f"Content-Length {length!r} with a block of {len(body)} bytes")
    body, kind = body[: int(length)], fields["warc-type"].lower()
    http, payload = b"", body
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = body.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length: *(\d+)", http)

    def page(name: str) -> int | None:
        """The page that an id of our own names."""
        value = fields.get(name, "").removeprefix("<").removesuffix(">")
        own = value.removeprefix(PAGE_URN)
        return int(own) if own != value and re.fullmatch(r"-?\d+", own) else None

    return {
        "page_id": page("warc-record-id"),
        "record_id": fields.get("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": page("warc-refers-to"),
        "refers_to_id": fields.get("warc-refers-to"),
        "date": fields.get("warc-date"),
        "stated_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": int(stated[1]) if kind == "revisit" and stated else len(payload),
    }


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of the *.warc.gz files of a folder, also of foreign ones: path, bytes, records (null: not known)."""
    fs, base = pafs.FileSystem.from_uri(folder)
    found = [(f.base_name, f.size, None) for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and f.base_name.endswith(".warc.gz")]
    return spark.createDataFrame(found, "path string, bytes long, records long")


def _members(manifest: DataFrame, folder: str, split: int) -> DataFrame:
    """path, bytes, starts (the places of the archives' members, by ranges of split bytes), errors (what is no whole record, wrong counts)."""
    ranges = manifest.where("bytes > 0").select("path", "bytes", "records", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    spread = ranges.repartition(max(1, min(100_000, ranges.count())), "path", "start")
    wide = pa.list_(pa.int64())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size, records, start in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                with fs.open_input_file(f"{base}/{path}") as file:
                    found = list(candidates(file, size, start, min(size, start + split)))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64()), pa.array([start], pa.int64()), pa.array([[x for x, _ in found]], wide), pa.array([[x for _, x in found]], wide)], names=["path", "bytes", "records", "start", "starts", "ends"])

    def confirm(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        cuts = np.cumsum([len(x) for x in table.column("starts")])[:-1]
        starts, ends = (np.concatenate([np.asarray(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("starts", "ends"))
        own = chain(starts, ends)
        kept = [x[o].tolist() for x, o in zip(np.split(starts, cuts), np.split(own, cuts), strict=True)]
        # between the end of a member and the begin of the next there is nothing, unless something is damaged
        size, records = table.column("bytes")[0].as_py(), table.column("records")[0].as_py()
        gaps = zip([0, *ends[own].tolist()], [*starts[own].tolist(), size], strict=True)
        errors = [f"bytes {a} to {b} hold no whole record" for a, b in gaps if a < b]
        if records is not None and records != own.sum():
            errors.append(f"{int(own.sum())} records, {records} were written")
        none = [[] for _ in range(len(kept) - 1)]
        return pa.table({"path": table.column("path"), "bytes": table.column("bytes"), "starts": pa.array(kept, wide), "errors": pa.array([errors, *none], pa.list_(pa.string()))})

    found = spread.mapInArrow(look, "path string, bytes long, records long, start long, starts array<long>, ends array<long>")
    chained = found.groupBy("path").applyInArrow(confirm, "path string, bytes long, starts array<long>, errors array<string>")
    return materialize(chained.where((F.size("starts") > 0) | (F.size("errors") > 0)), "members")


def read_archives(manifest: DataFrame, folder: str, split: int = SPLIT_BYTES) -> DataFrame:
    """All records in the manifest's archives: path, record_id, record_type, url, date, refers_to_id, payload, payload_bytes,
    payload_digest, error; page_id and refers_to for records whose ids name pages.

    The digest of a record is computed from the payload that was read; a revisit states its own. Damaged bytes, records that cannot be
    parsed and wrong numbers of records are rows of their own, with error and nothing but the path.
    """
    members = _members(manifest, folder, split)
    spread = members.repartition(max(1, min(100_000, members.count())), "path", F.get("starts", F.lit(0)))
    schema = "page_id long, record_id string, url string, record_type string, refers_to long, refers_to_id string, date string, payload_bytes long, payload_digest string, payload binary, path string, error string"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size, starts, errors in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows, held = [{"path": path, "error": e} for e in errors], 0
                with fs.open_input_file(f"{base}/{path}") as file:
                    for start, raw in zip(starts, records_at(file, size, starts), strict=True):
                        try:
                            row = parse_record(raw)
                            row["payload_digest"] = row["stated_digest"] if row["payload"] is None else payload_digest(row["payload"])
                        except ValueError as e:
                            row = {"error": f"record at byte {start}: {e}"}
                        rows.append({**row, "path": path})
                        held += len(raw)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spread.mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder and reads them back."""
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_referents(pages, least_bytes), folder)
    return read_archives(manifest, folder)
