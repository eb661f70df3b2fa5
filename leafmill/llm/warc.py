"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own.  The reader's tasks take byte ranges: a task scans its range for the gzip
magic, accepts a candidate only if it decodes to a WARC header, owns the records that begin inside the range, and
reads past the range's end to finish the last one.  From one owned member the next begins where it ends; the scan
is taken up again only where no valid member begins.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Payloads below this many bytes are always stored whole.
REVISIT_FROM = 1000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, path string"


def _filesystem(uri: str):
    """pyarrow's file system for a folder's URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, digest: str, n: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record as a gzip member; ``payload`` None makes it a revisit of ``refers_to``."""
    uri = "".join(c for c in (url or "") if c.isprintable() and c != " ") or f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:leafmill:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}", "Content-Type: text/html"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:leafmill:page:{refers_to}>"]
    body = payload or b""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict | None:
    """Headers (lower-case names) and ``payload`` of a decoded record, or None if it is none."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        return None
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = out.get("content-length", "")
    if not n.isdigit() or rest[int(n) :] != b"\r\n\r\n":
        return None
    return out | {"payload": rest[: int(n)]}


def with_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Payload, digest and revisit decision of every page.

    Copies are met by digest and length: the partial maximum per digest is small, and the join back to the pages is
    one that Spark splits where a digest is frequent.
    """
    html: Column = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col(url_col) if url_col in pages.columns else F.lit(None)).cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = rows.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    first = materialize(groups.select(F.col("payload_digest").alias("__digest"), "refers_to"), "warc-first")
    joined = rows.join(first, rows.payload_digest == first["__digest"], "left").drop("__digest")
    return joined.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(None)).otherwise(F.col("refers_to")))


def write(pages: DataFrame, uri: str, **columns: str) -> DataFrame:
    """Write all pages as archives, one a task, in the folder ``uri``; returns the written list ``(path, bytes, records)``.

    Null and empty payloads, repeated rows and rows without an id are records like any other; an empty table gives no file.

    A file's name is new at each attempt, and the list, written by Spark's committer, names the files of successful
    attempts only: what a lost or doubled task left is never read.
    """
    rows = with_types(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]):
        fs, folder = _filesystem(uri)
        out, path, size, n = None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                revisit = row["refers_to"] is not None
                data = record(row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], None if revisit else row["payload"], row["refers_to"])
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path.rsplit("/", 1)[1]], "bytes": [size], "records": [n]})

    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class _Bytes:
    """Bytes of a file by position, read ahead in steps; beyond the file's end there are none."""

    def __init__(self, file, step: int = 1 << 20):
        self.file, self.step, self.start, self.data, self.ended = file, step, 0, b"", False

    def at(self, pos: int, n: int) -> bytes:
        if pos < self.start or pos + n > self.start + len(self.data) and not self.ended:
            self.file.seek(pos)
            parts, left = [], max(n, self.step)
            while left and (some := self.file.read(left)):
                parts.append(some)
                left -= len(some)
            self.start, self.data, self.ended = pos, b"".join(parts), left > 0
        return self.data[pos - self.start : pos - self.start + n]


def member(data: _Bytes, pos: int) -> tuple[dict, int] | None:
    """The record whose gzip member begins at ``pos``, and where the member ends; None if none does."""
    unpack, out, at = zlib.decompressobj(31), [], pos
    first = True
    try:
        while not unpack.eof:
            some = data.at(at, 1 << 12 if first else 1 << 16)
            if not some:
                return None
            out.append(unpack.decompress(some))
            at += len(some)
            if first and out[0] and not b"WARC/1.".startswith(out[0][:7]):
                return None
            first = not out[0]
    except zlib.error:
        return None
    found = parse(b"".join(out))
    return found and (found, at - len(unpack.unused_data))


class DamagedArchive(ValueError):
    """An archive that does not hold what was written."""


def records(file, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """``(position, record)`` of the members that begin in ``[start, end)``.

    A candidate found by scanning is taken only if what follows it is the file's end or another valid member, so
    bytes inside a member that look like one do not count; the members after it are found without scanning, and where
    one of these is expected and none is, the archive is damaged.  What follows a member is judged by the magic bytes
    and the first of the record beyond the range, too.  Nothing is looked for beyond the file's end.
    """
    data, pos, trusted = _Bytes(file), start, start == 0
    while data.at(pos, 1) and (pos < end or trusted):
        found = member(data, pos) if data.at(pos, 3) == MAGIC else None
        if trusted and not found and data.at(pos, 3) != MAGIC[: len(data.at(pos, 3))]:
            trusted = False  # bytes behind the last record that are no member: they are passed over
        if trusted and not found and len(data.at(pos, 18)) == 18:
            raise DamagedArchive(f"no record can be read at byte {pos}")
        if pos >= end:
            return
        if found and not trusted and data.at(found[1], 1) and not member(data, found[1]):
            found = None
        if found:
            yield pos, found[0]
            pos, trusted = found[1], True
            continue
        pos, trusted = pos + 1, False
        while pos < end:
            some = data.at(pos, min(1 << 16, end - pos) + 2)
            if len(some) < len(MAGIC):
                return
            k = some.find(MAGIC)
            if k >= 0:
                pos += k
                break
            pos += len(some) - 2


def row_of(r: dict) -> dict:
    """A record as a row.  A response's payload must have the length and the digest that its header names."""
    ident = [h.removeprefix("<urn:leafmill:page:").removesuffix(">") for h in (r["warc-record-id"], r.get("warc-refers-to", ""))]
    size, digest = int(r["x-payload-length"]), r["warc-payload-digest"].removeprefix("sha1:")
    if r["warc-type"] == "response":
        own = hashlib.sha1(r["payload"]).hexdigest()
        if (len(r["payload"]), own) != (size, digest):
            raise DamagedArchive(f"record {ident[0]!r} holds {len(r['payload'])} bytes with digest {own}, its header says {size} and {digest}")
    return {"page_id": int(ident[0]) if ident[0] else None, "payload_bytes": size, "payload_digest": digest, "record_type": r["warc-type"], "refers_to": int(ident[1]) if ident[1] else None, "url": r.get("warc-target-uri")}


def read(files: DataFrame, uri: str, range_mb: float = 8, keep_payload: bool = True) -> DataFrame:
    """All records of the archives ``files(path, bytes)`` in ``uri``, by byte ranges of ``range_mb`` spread over the tasks.

    ``path`` names a record's archive.  A damaged record ends the read with :class:`DamagedArchive`; :func:`complete` tells
    whether all records that were written have come back.  An empty list gives no records.
    """
    step = int(range_mb * 2**20)
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(step))).alias("start"))
    # A row stands for 8 MB, so the number of tasks is given: by size, all rows would end in one.
    n = int(files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / step)), F.lit(0))).first()[0])
    spread = ranges.repartition(max(1, min(n, max(4 * files.sparkSession.sparkContext.defaultParallelism, n // 32))), "path", "start")

    def run(batches):
        fs, folder = _filesystem(uri)
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                with fs.open_input_file(f"{folder}/{row['path']}") as file:
                    for _, r in records(file, row["start"], min(row["start"] + step, row["bytes"])):
                        rows.append(row_of(r) | {"payload": r["payload"] if keep_payload else None, "path": row["path"]})
                        size += len(r["payload"])
                        if len(rows) >= 1000 or keep_payload and size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("path", pa.string())])
    return spread.mapInArrow(run, SCHEMA)


def complete(files: DataFrame, back: DataFrame) -> None:
    """DamagedArchive if an archive of ``files`` has given more or fewer rows of ``back`` than it has records."""
    found = back.groupBy("path").agg(F.count("*").alias("found"))
    wrong = files.join(found, "path", "left").where(F.coalesce("found", F.lit(0)) != F.col("records")).limit(3).collect()
    if wrong:
        raise DamagedArchive("records read and written: " + ", ".join(f"{r['found'] or 0} of {r['records']} in {r['path']}" for r in wrong))


def round_trip(pages: DataFrame, range_mb: float = 8, **columns: str) -> DataFrame:
    """Write archives in the shared folder and read them back by ranges: the digest columns of every record.

    A null html is an empty payload; a null page_id stays null (a copy of such a page revisits the largest id, and
    pages none of whose copies has an id are all responses); rows that repeat the largest page_id are all responses.
    An empty table gives no file and no record.  Only page_id, url and html are read.
    """
    spark: SparkSession = pages.sparkSession
    uri = new_path(spark, "warc")
    files = write(pages, uri, **columns)
    back = materialize(read(files, uri, range_mb, keep_payload=False).drop("payload", "url"), "warc-back")
    complete(files, back)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB, over table pages.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(encode(html)) AS h FROM p),
g AS (SELECT h, max(page_id) AS first FROM d WHERE n >= {REVISIT_FROM} GROUP BY h HAVING count(*) > 1)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN g.first IS NULL OR g.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.first <> d.page_id THEN g.first END AS refers_to
FROM d LEFT JOIN g ON g.h = d.h
"""
