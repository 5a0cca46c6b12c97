"""Operator 8, WARC: archives of gzip members with revisit records, and a reader that salvages.

`write_archives` stores each row as a record of its own gzip member. Of rows with equal
payloads the one with the largest id is a response and the others revisit it. Which is decided on
(id, digest) rows alone; the html is then dealt out by id, so copies of one page spread evenly. Where ids are null or repeated,
rows are numbered first (by writing the table), and the number stands in for the id.

`read_archives` checks every member's CRC, length and block digest. After a failed check it
searches for the next member or version line from which a whole record can be read, goes on there,
and logs the bytes between as quarantined.

Defined results: null html is an empty payload; a null url leaves out the target; every row is a record: one with a null id has a
null page_id, which counts as the smallest, and of rows that repeat an id each has its own (of the largest id's equal payloads one is the response);
an empty table gives no records; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, join_groups, materialize, new_folder, small
from .files import Roller, read_all

#: Bytes after which a new archive begins; one archive is read as a whole.
ROLL = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_NEXT = re.compile(re.escape(_MEMBER) + b"|" + re.escape(_VERSION))


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, row: int | None) -> str:
    """A record's name: its page, and its row's number where pages aren't unique or have no id."""
    return f"<urn:page:{'' if page is None else page}{'' if row is None else f':row:{row}'}>"


def build_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z", row: int | None = None, refers_row: int | None = None) -> bytes:
    """One record, not compressed. A revisit keeps the http headers, which tell the payload's length."""
    revisit = refers_to is not None or refers_row is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, row)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, refers_row)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record that begins at a place, and where it ends; ValueError if anything about it is wrong."""
    head = data.find(b"\r\n\r\n", at)
    if data[at : at + len(_VERSION)] != _VERSION or head < 0:
        raise ValueError("no header")
    headers = {}
    for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("broken header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise ValueError("no length")
    block = data[head + 4 : head + 4 + int(length)]
    end = head + 4 + int(length) + 4
    if len(block) < int(length) or data[end - 4 : end] != b"\r\n\r\n":
        raise ValueError("truncated record")
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise ValueError("wrong block digest")
    return Record(headers, block), end


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """A gzip member's content as far as it can be inflated, where that ends, and what is wrong (empty if nothing)."""
    z, out, here = zlib.decompressobj(31), [], at
    while not z.eof:
        if here >= len(data):
            return b"".join(out), len(data), "truncated member"
        try:
            out.append(z.decompress(data[here : here + step]))
        except zlib.error as e:
            if step > 1:  # what the step gave before the damage
                z, step = zlib.decompressobj(31), 1
                out = [z.decompress(data[at:here])] if here > at else []
                continue
            return b"".join(out), here, f"broken member: {e}"
        here += step
    return b"".join(out), min(here, len(data)) - len(z.unused_data), ""


def _within(content: bytes) -> tuple[list[Record], list[str]]:
    """The records of a member's content, and what is wrong between them."""
    out, wrong, here, lost = [], [], 0, None
    while here < len(content):
        try:
            record, end = _parse(content, here)
        except ValueError as e:
            lost = (here, str(e)) if lost is None else lost
            found = content.find(_VERSION, here + 1)
            here = found if found >= 0 else len(content)
            continue
        if lost is not None:
            wrong.append(f"{lost[1]}, inflated bytes {lost[0]} to {here}")
            lost = None
        out.append(record)
        here = end
    if lost is not None:
        wrong.append(f"{lost[1]}, inflated bytes {lost[0]} to {here}")
    return out, wrong


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that can be read, and the gaps between them.

    Of a broken member the records that were inflated count; a gap within a member has the member's place.
    """
    at, lost, why = 0, None, ""
    reached, inflated = 0, b""  # of the last broken member
    while at < len(data):
        records, wrong, broken = [], [], ""
        if data[at : at + 3] == _MEMBER:
            content, end, broken = _inflate(data, at)
            records, wrong = _within(content)
            if broken:
                reached, inflated = end, content
        else:
            try:
                record, end = _parse(data, at)
                if at < reached and data[at:end] in inflated:  # a broken member stored it as it is: it was read already
                    at = end
                    continue
                records = [record]
            except ValueError as e:
                broken = str(e)
        if lost is not None and (records or not broken):
            yield Gap(lost, at, why)
            lost = None
        yield from records
        if broken:
            lost, why = (at, "; ".join([broken, *wrong])) if lost is None else (lost, why)
            found = _NEXT.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        yield from (Gap(at, end, x) for x in wrong)
        at = end
    if lost is not None:
        yield Gap(lost, len(data), why)


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)(?::row:\d+)?>", value or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, folder: str, smallest: int = 0, roll: int = ROLL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives; path, records and bytes of each. Payloads under `smallest` bytes are never revisits."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    unique = rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 or page_id is null").isEmpty()
    if not unique:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "page-rows")
    key, best = ("page_id", F.max("page_id")) if unique else ("row", F.max(F.struct("page_id", "row")))
    seen = materialize(rows.select(*dict.fromkeys(("page_id", key)), F.sha1(F.col("html").cast("binary")).alias("hex"), F.octet_length("html").alias("n")), "page-digests")
    last = seen.where(F.col("n") >= smallest).groupBy("hex").agg(best.alias("last"), F.count("*").alias("copies"))
    page, row = ("last", "last") if unique else ("last.page_id", "last.row")
    other = F.col(row) != F.col(key)
    placed = join_groups(seen, last, ["hex"], "copies", seen.count()).select(F.col(key).alias("p"), F.when(other, F.col(page)).alias("refers_to"), (F.lit(None).cast("long") if unique else F.when(other, F.col(row))).alias("refers_row"))
    found = rows.join(placed, F.col(key) == F.col("p")).select("page_id", "url", "html", "refers_to", (F.lit(None).cast("long") if unique else F.col("row")).alias("row"), "refers_row")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches):
        files, out = Roller(folder, TaskContext.get().partitionId(), ".warc.gz", roll), {}
        for b in small(batches):
            for page, url, text, refers, row, refers_row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = member(build_record(page, url, text.encode(), refers, row=row, refers_row=refers_row))
                path, _ = files.append(data)
                n, size = out.get(path, (0, 0))
                out[path] = n + 1, size + len(data)
        files.close()
        yield batch({"path": list(out), "records": [n for n, _ in out.values()], "bytes": [s for _, s in out.values()]}, schema)

    return found.mapInArrow(write, "path string, records long, bytes long")


def read_archives(archives: DataFrame, path_col: str = "path", with_payload: bool = False) -> DataFrame:
    """A row per record (page_id, payload_bytes, payload_digest, record_type, refers_to) and per quarantined gap (record_type `gap`, with path, start, end and reason)."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]
    fields += [("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for x in salvage(read_all(path)):
                    if isinstance(x, Gap):
                        rows.append((None, None, None, "gap", None, path, x.start, x.end, x.reason, None))
                        continue
                    head, _, payload = x.block.partition(b"\r\n\r\n")
                    kind = x.headers.get("warc-type")
                    told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                    size = int(told[1]) if kind == "revisit" and told else len(payload)
                    sha = digest(payload) if kind == "response" else x.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((_page(x.headers.get("warc-record-id")), size, sha, kind, _page(x.headers.get("warc-refers-to")), path, None, None, None, payload))
                if rows:
                    yield batch({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema)

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, start long, end long, reason string" + ", payload binary" * with_payload
    return archives.select(path_col).mapInArrow(read, out)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The reader's rows, quarantined gaps among them, are written to a table before any is returned. Archives that were just
    written must give back every record: if not, an error names the gaps' table.
    """
    spark = pages.sparkSession
    files = materialize(write_archives(pages, folder or new_folder(spark, "warc")), "archives")
    wrote = files.agg(F.count("*").alias("files"), F.sum("records").alias("records")).first()
    log = materialize(read_archives(files.repartition(max(1, wrote["files"]), "path")), "warc-log")
    gaps = log.where("record_type = 'gap'")
    lost = (wrote["records"] or 0) - (log.count() - gaps.count())
    if lost:
        raise RuntimeError(f"{lost} records were lost; gaps are logged in {gaps.inputFiles()}")
    return log.where("record_type != 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
