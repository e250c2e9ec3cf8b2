"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: every page is one record in a gzip member of its own.  Of records with equal payloads of at least
``smallest`` bytes the one with the smallest page id is the response and the others revisit it.  Only digests and
ids are grouped, never payloads.  A task writes its files under temporary names in the shared folder and renames them,
so a task that runs again replaces its own files.

Reader: gzip members and plain records are checked (inflation, version line, length, closing lines, payload digest).
After a failed check it searches for the next member or version line, goes on there, and logs the bytes left out.
Within a member it searches the inflated bytes, of a cut or corrupt one those that came out before the damage; such a gap
has the member's own bounds, or those up to its last good record, and its reason names the inflated bytes.

Null html is an empty payload.  Null page ids are always responses.  Rows that repeat id and payload are each written
as the first of them is.  An empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, DATE = b"WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file is closed after so many compressed bytes.
FILE_BYTES, LEVEL, CHUNK = 16 << 20, 3, 1 << 16
RECORDS = "path string, offset long, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_MEMBER, _START, _LINE = b"\x1f\x8b\x08", re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n"), re.compile(rb"WARC/1\.[01]\r\n")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with the payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    name = "" if page_id is None else page_id
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def decided(pages: DataFrame, smallest: int, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """``(page_id, url, html, refers_to)``: which records revisit which."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("sha"))
    light = rows.filter(F.octet_length("html") >= smallest).select("page_id", "sha")
    first = light.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter(F.col("first") < F.col("last"))
    again = light.join(first, "sha").filter(F.col("page_id") > F.col("first")).select("page_id", "sha", F.col("first").alias("refers_to")).distinct()
    return rows.join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def write_warc(pages: DataFrame, folder: str, smallest: int = 0, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write the archives under ``folder`` and return the manifest ``(file, records, bytes)``."""
    rows = decided(pages, smallest, id_col, html_col, url_col).sortWithinPartitions(F.col("page_id").asc_nulls_first(), "url", "html")

    def write(batches):
        from pyspark import TaskContext

        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, number, out, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            out.close()
            fs.move(temporary, f"{root}/part-{part:05d}-{number:04d}.warc.gz")
            done.append((f"part-{part:05d}-{number:04d}.warc.gz", records, size))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    temporary = f"{root}/_writing-{uuid.uuid4().hex}"
                    out, records, size = fs.open_output_stream(temporary), 0, 0
                payload = html.encode()
                data = _member(record(page_id, url, payload, base32_sha1(payload), refers_to))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= FILE_BYTES:
                    close()
                    number, out = number + 1, None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[], [], []], [pa.string(), pa.int64(), pa.int64()], strict=True)], ["file", "records", "bytes"])

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "file string, records long, bytes long")


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and where it ends; raises ValueError where a check fails."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError("no version line")
    cut = data.find(b"\r\n\r\n", at)
    if cut < 0:
        raise ValueError("no end of header")
    head = _headers(data[at:cut])
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = cut + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length does not end the record")
    block = data[start:end]
    http, _, payload = block.partition(b"\r\n\r\n") if "msgtype=response" in head.get("content-type", "") else (b"", b"", block)
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if kind == "revisit":
        size = int(_headers(http).get("content-length", "0") or 0)
    else:
        found = base32_sha1(payload)
        if digest and digest != found:
            raise ValueError("payload digest differs")
        digest = found
    return {"record_type": kind, "record_id": head.get("warc-record-id", ""), "uri": head.get("warc-target-uri", ""), "refers_to": head.get("warc-refers-to"),
            "payload_bytes": size, "payload_digest": digest, "payload": None if kind == "revisit" else payload}, end + 4


def _damaged(data: bytes, at: int, most: int | None = None) -> tuple[bytes, int]:
    """What comes out of a damaged member, up to ``most`` bytes, and where that ends: chunks first, single bytes in the last one."""
    view, z, fed, out, size, step = memoryview(data), zlib.decompressobj(31), at, [], 0, CHUNK
    while fed < len(data) and not z.eof and (most is None or size < most):
        kept = z.copy() if step > 1 else None
        try:
            piece = z.decompress(view[fed : fed + step])
        except zlib.error:
            if step == 1:
                break
            z, step = kept, 1
            continue
        if step > 1 and most is not None and size + len(piece) >= most:
            z, step = kept, 1
            continue
        out.append(piece)
        size, fed = size + len(piece), min(fed + step, len(data))
    return b"".join(out), fed


def _within(inside: bytes) -> tuple[list[dict], list[tuple[int, int, str]], int]:
    """The records of inflated bytes that pass their checks, the gaps between them, and where the last record ends."""
    found, gaps, pos, last = [], [], 0, 0
    while pos < len(inside):
        try:
            r, pos = parse_record(inside, pos)
            found.append(r)
            last = pos
        except ValueError as why:
            m = _LINE.search(inside, pos + 1)
            end = m.start() if m else len(inside)
            if gaps and gaps[-1][1] == pos:
                gaps[-1] = (gaps[-1][0], end, gaps[-1][2])
            else:
                gaps.append((pos, end, str(why)))
            pos = end
    return found, gaps, last


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """All records of a file that pass their checks, with offsets, and the gaps (start, end, reason) left out."""
    records, gaps, at, view, open_gap = [], [], 0, memoryview(data), False

    def lost(end, why):
        if open_gap and gaps[-1][1] == at:
            gaps[-1] = (gaps[-1][0], end, gaps[-1][2])
        else:
            gaps.append((at, end, why))

    while at < len(data):
        try:
            if data[at : at + 3] == _MEMBER:
                z, fed, out, why = zlib.decompressobj(31), at, [], None
                try:
                    while not z.eof:
                        if fed >= len(data):
                            raise ValueError("member is cut short")
                        out.append(z.decompress(view[fed : fed + CHUNK]))
                        fed = min(fed + CHUNK, len(data))
                    inside, end = b"".join(out), fed - len(z.unused_data)
                except (ValueError, zlib.error) as e:
                    why, inside = str(e), _damaged(data, at)[0]
                found, left, last = _within(inside)
                if why is not None:
                    if not found:
                        raise ValueError(why)
                    # The bytes of its good records are settled, what follows them is searched.
                    end, left = _damaged(data, at, last)[1], [g for g in left if g[0] < last]
                elif left and not found:
                    lost(end, left[0][2])
                    at, open_gap = end, True
                    continue
                records += [r | {"offset": at} for r in found]
                gaps += [(at, end, f"{reason} (bytes {a} to {b} of the inflated member)") for a, b, reason in left]
                at, open_gap = end, False
                if why is not None:
                    m = _START.search(data, at)
                    end = m.start() if m else len(data)
                    if end > at:
                        lost(end, why)
                        at, open_gap = end, True
            else:
                r, end = parse_record(data, at)
                records.append(r | {"offset": at})
                at, open_gap = end, False
        except ValueError as why:
            m = _START.search(data, at + 1)
            end = m.start() if m else len(data)
            lost(end, str(why))
            at, open_gap = end, True
    return records, gaps


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``folder`` (files up to 2 GB); ``payloads=False`` leaves the payloads out."""

    def read(batches):
        names = [f.split(" ")[0] for f in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                found, _ = salvage(content.as_py())
                for i in range(0, len(found), 500):
                    rows = [r | {"path": path.as_py()} for r in found[i : i + 500]]
                    yield pa.RecordBatch.from_arrays([pa.array([None if n == "payload" and not payloads else r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return _files(spark, folder).mapInArrow(read, RECORDS)


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, start, end, reason)`` of the bytes that :func:`read_warc` leaves out."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                gaps = salvage(content.as_py())[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * len(gaps), pa.string()), *[pa.array([g[i] for g in gaps], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]], ["path", "start", "end", "reason"])

    return _files(spark, folder).mapInArrow(read, "path string, start long, end long, reason string")
