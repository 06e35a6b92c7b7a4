"""WARC records in ZIP archives: written in parallel, then read by ranges without extraction.

An archive stores (uncompressed) one WARC member and one index member that gives each record's range.
In the WARC member each record is a gzip member of its own, as is usual for WARC files. A reader parses
the end record, its ZIP64 form and the central directory, finds both members, and then reads just the
byte ranges of the records it wants.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import picked
from .scratch import n_tasks, small_batches, stored
from .words import pieces

#: Parts that the rows of one payload are dealt to.
DEALS = 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes, digest_: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page refers_to with the HTTP head alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest_}"]
    if url:
        head.append(f"WARC-Target-URI: {url.encode('unicode_escape').decode()}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.decode().lower(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines if b":" in x)}

    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {first[:40]!r}")
    warc = fields(lines)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.split(b"\r\n")[1:]), payload


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def members(file) -> list[Member]:
    """The central directory of a ZIP archive (pyarrow file or any with size() and read_at()), ZIP64 too."""
    end = file.size()
    low = max(0, end - 66_000)
    tail = file.read_at(end - low, low)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end64 = file.read_at(56, where)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        count, size, start = struct.unpack("<QQQ", end64[32:56])
    data, p, out = file.read_at(size, start), 0, []
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack("<H", data[p + 10 : p + 12])
        packed, full, n, extra, comment = struct.unpack("<IIHHH", data[p + 20 : p + 34])
        (header,) = struct.unpack("<I", data[p + 42 : p + 46])
        name, x = data[p + 46 : p + 46 + n].decode(), data[p + 46 + n : p + 46 + n + extra]
        while len(x) >= 4:
            kind, m = struct.unpack("<HH", x[:4])
            if kind == 1:  # the 64-bit values of those fields that are full, in this order
                wide = iter(struct.unpack(f"<{m // 8}Q", x[4 : 4 + m // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            x = x[4 + m :]
        out.append(Member(name, method, full, header))
        p += 46 + n + extra + comment
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; ranges need stored members")
    local = file.read_at(30, member.header)
    n, extra = struct.unpack("<HH", local[26:30])
    return member.header + 30 + n + extra


_WRITTEN = "path string, records long, bytes long"


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes a record for each row of pages to ZIP archives under path -> (path, records, bytes) of each archive.

    Of rows with equal payloads of least_bytes or more, those with the smallest id are responses and the
    others revisit it; other rows are responses. Null html is an empty payload. A row with a null id is
    a response unless its payload has an id's; it is written with an empty page id. Repeats of a row
    are records of their own. Rows that can't be told apart by id keep their url. Other columns are not
    written, whatever their names. No rows: no archives.
    A task writes under names of its own and reports them at its end, so what a lost task left is not read.
    """
    small_batches(pages.sparkSession)
    p = picked(pages, page_id=id_col, url=url_col, html=html_col)
    p = p.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("hash", F.sha1(F.col("html").cast("binary")))
    # Only payloads that several rows have need their first; a payload of very many rows is dealt to DEALS parts.
    first = p.where(F.octet_length("html") >= least_bytes).groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("hash", "first", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = p.withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.lit(DEALS)).cast("int"))
    marked = dealt.join(first, ["hash", "deal"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        todo = iter(pieces(batches, "html"))
        for b in todo:
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                index, at = [], 0
                with archive.open(DATA, "w", force_zip64=True) as data:
                    while b is not None:
                        for page, url, html, first_ in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                            payload = html.encode()
                            raw = gzip.compress(record("" if page is None else str(page), url or "", payload, digest(payload), None if first_ is None or first_ == page else str(first_)), 6, mtime=0)
                            data.write(raw)
                            index.append(json.dumps({"page": page, "offset": at, "length": len(raw)}))
                            at += len(raw)
                        b = next(todo, None) if at < archive_bytes else None
                archive.writestr(INDEX, "\n".join(index))
            yield pa.RecordBatch.from_pylist([{"path": f"{path.rstrip('/')}/{name}", "records": len(index), "bytes": at}])

    return stored(marked.mapInArrow(run, _WRITTEN))


def read_index(archives: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """archives (path) -> (path, offset, lengths): ranges of whole records, of about range_bytes, within each archive's file."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, name = FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    found = {m.name: m for m in members(f)}
                    start, index = data_start(f, found[DATA]), found[INDEX]
                    lines = f.read_at(index.size, data_start(f, index)).decode().splitlines()
                offset, lengths, out = start, [], []
                for n in (json.loads(x)["length"] for x in lines):
                    if lengths and sum(lengths) + n > range_bytes:
                        out.append({"path": path, "offset": offset, "lengths": lengths})
                        offset, lengths = offset + sum(lengths), []
                    lengths.append(n)
                if lengths:
                    out.append({"path": path, "offset": offset, "lengths": lengths})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    return archives.select("path").mapInArrow(run, "path string, offset long, lengths array<long>")


_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_records(ranges: DataFrame, payload: bool = True) -> DataFrame:
    """Records of read_index()'s ranges. payload_bytes and payload_digest are of the full payload, for revisits too.

    payload is null for revisits, or with payload=False for all. A response whose payload does not have
    its digest or length raises an error.
    """

    def number(x: str) -> int | None:
        x = x.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, name = FileSystem.from_uri(r["path"])
                with fs.open_input_file(name) as f:
                    raw = f.read_at(sum(r["lengths"]), r["offset"])
                out, at = [], 0
                for n in r["lengths"]:
                    warc, http, body = parse_record(gzip.decompress(raw[at : at + n]))
                    at += n
                    want, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    revisit = warc["warc-type"] == "revisit"
                    if not revisit and (len(body) != size or digest(body) != want):
                        raise ValueError(f"{warc['warc-record-id']}: the payload is not what its digest says")
                    url = warc.get("warc-target-uri")
                    out.append((number(warc["warc-record-id"]), url and url.encode().decode("unicode_escape"), warc["warc-type"], size, want, number(warc["warc-refers-to"]) if revisit else None, None if revisit or not payload else body))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # A number of tasks is given, as ranges' own rows are small and would be brought together.
    return ranges.repartition(n_tasks(ranges.sparkSession), F.xxhash64("path", "offset")).mapInArrow(run, _RECORDS)
