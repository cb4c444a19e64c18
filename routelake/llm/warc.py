"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with an offset index, read by offset."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import get, materialize, new_path, put, read, ship

#: Payload bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 16_000_000
#: Bytes inflated at a time, and pages handled at a time.
CHUNK, SLICE = 1 << 18, 64
GZIP = 31
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def response(page_id: int | None, url: str | None, payload: bytes, sha: str, date: str) -> bytes:
    """A response record with its HTTP block."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisit(whole: bytes, refers_to: int | None) -> bytes:
    """The revisit record of a response record: it keeps the HTTP headers alone, and names the page whose payload is the same."""
    head, block = whole.split(b"\r\n\r\n", 1)
    block = block[: block.index(b"\r\n\r\n") + 4]
    lines = []
    for line in head.split(b"\r\n"):
        if line == b"WARC-Type: response":
            line = b"WARC-Type: revisit"
        elif line.startswith(b"Content-Length: "):
            line = b"Content-Length: %d" % len(block)
        lines.append(line)
    lines.append(f"WARC-Profile: {REVISIT_PROFILE}".encode())
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_name(refers_to)}".encode(), b"X-Refers-To-Page-Id: %d" % refers_to]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def inflate(data: bytes) -> Iterator[bytes]:
    """The plain bytes of gzip data, one member or many, a chunk at a time."""
    while data:
        stream = zlib.decompressobj(GZIP)
        at = 0
        while at < len(data) and not stream.eof:
            part = stream.decompress(data[at : at + CHUNK])
            at += CHUNK
            if part:
                yield part
        if not stream.eof:
            raise ValueError("gzip data ends early")
        rest = stream.unused_data + data[at:]
        data = rest.lstrip(b"\0")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, whole record) of each record, inflating the stream once."""
    held = bytearray()
    need, head, top = 0, None, 0
    for part in inflate(data):
        held += part
        while True:
            if head is None:
                top = held.find(b"\r\n\r\n")
                if top < 0:
                    break
                head = headers(bytes(held[:top]))
                need = top + 4 + int(head["content-length"]) + 4
            if len(held) < need:
                break
            whole = bytes(held[:need])
            yield head, whole[top + 4 : -4], whole
            del held[:need]
            head = None
    if held:
        raise ValueError("an archive ends inside a record")


def normalise(data: bytes, revisits: dict[int, int | None]) -> tuple[bytes, bytes]:
    """A whole-file gzip archive as one member per record, and its index: a JSON line per record with offset and length.

    revisits: place of a record -> the page that holds its payload; those become revisit records.
    """
    out, index = bytearray(), []
    for k, (head, _, whole) in enumerate(records(data)):
        if k in revisits:
            whole = revisit(whole, revisits[k])
        squeeze = zlib.compressobj(4, zlib.DEFLATED, GZIP)
        member = squeeze.compress(whole) + squeeze.flush()
        index.append({"offset": len(out), "length": len(member), "type": "revisit" if k in revisits else "response", "uri": head["warc-target-uri"],
            "digest": head["warc-payload-digest"], "id": head["warc-record-id"]})
        out += member
    return bytes(out), "".join(json.dumps(x) + "\n" for x in index).encode()


ROWS = pa.schema([("archive", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("u", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string())])


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes every page as a response record, in archives that are one gzip stream each, and returns what stands where.

    Tasks write the pages that they read, roll archives by size and hold one at a time; no payload is shuffled.
    """
    spark = pages.sparkSession
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size, rows = TaskContext.get().partitionId(), 0, 0, []
        squeeze, out = zlib.compressobj(1, zlib.DEFLATED, GZIP), bytearray()

        def close() -> pa.RecordBatch:
            nonlocal squeeze, out, k, size, rows
            out += squeeze.flush()
            name = f"{part:08d}-{k:06d}"
            put(folder, f"{name}.warc.gz", bytes(out))
            done = pa.RecordBatch.from_pylist([{"archive": name, "place": i, "page_id": p, "u": u, "n_bytes": n, "digest": d} for i, (p, u, n, d) in enumerate(rows)], ROWS)
            squeeze, out, k, size, rows = zlib.compressobj(1, zlib.DEFLATED, GZIP), bytearray(), k + 1, 0, []
            return done

        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                cols = [c.to_pylist() for c in b.slice(at, SLICE).columns]
                for page_id, url, payload, u in zip(*cols, strict=True):
                    sha = digest(payload)
                    out += squeeze.compress(response(page_id, url, payload, sha, date))
                    rows.append((page_id, u, len(payload), sha))
                    size += len(payload)
                    if size >= ARCHIVE_BYTES:
                        yield close()
        if rows:
            yield close()

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), F.coalesce(F.xxhash64("url"), F.lit(0)).alias("u"))
    return materialize(base.mapInArrow(write, "archive string, place long, page_id long, u long, n_bytes long, digest string"), "warc-rows")


def choose(rows: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Writes beside each archive which of its records revisit which page.

    Of records with equal payloads of at least min_bytes, that with the largest page_id is the response (null page_ids
    come before all others; equal ones are told apart by url; rows equal in all are each the response). Payloads that
    several records share are one row on the other side of the join, and AQE splits their records.
    """
    mark = F.struct(F.col("page_id"), F.col("u"))
    shared = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max(mark).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    shared = materialize(shared, "warc-shared")  # joined by an exchange of its own, which lets AQE split a digest
    again = rows.join(shared, "digest").where(~F.col("first").eqNullSafe(mark)).select("archive", "place", F.col("first.page_id").alias("refers_to"))

    def note(table: pa.Table) -> pa.Table:
        lines = "".join(json.dumps([p, r]) + "\n" for p, r in zip(table["place"].to_pylist(), table["refers_to"].to_pylist(), strict=True))
        put(folder, table["archive"][0].as_py() + ".revisits", lines.encode())
        return pa.table([pa.array([table.num_rows], pa.int64())], ["n"])

    again.groupBy("archive").applyInArrow(note, "n long").agg(F.sum("n")).collect()  # one row


def normalise_archives(spark: SparkSession, source: str, folder: str) -> None:
    """Rewrites every archive under source with a member per record, and an index beside it."""
    ship(spark)
    files = _archives(spark, source)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name = b.column(0)[i].as_py()
                noted = get(source, f"{name}.revisits") or b""
                data, index = normalise(b.column(1)[i].as_buffer().to_pybytes(), dict(map(json.loads, noted.splitlines())))
                put(folder, f"{name}.warc.gz", data)
                put(folder, f"{name}.cdxj", index)
                yield pa.record_batch([pa.array([len(data)], pa.int64())], ["n"])

    files.mapInArrow(rewrite, "n long").agg(F.sum("n")).collect()  # one row


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.regexp_extract("path", r"([^/]+)\.warc\.gz$", 1).alias("name"), "content")


RECORD_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Per record, found through the index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's bytes and digest are taken from its payload, and must agree with its headers; a revisit's come from the
    headers that it repeats.
    """
    ship(spark)
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                archive, rows = b.column(1)[i].as_buffer(), []
                for line in get(folder, b.column(0)[i].as_py() + ".cdxj").splitlines():
                    at = json.loads(line)
                    head, block, _ = next(records(archive[at["offset"] : at["offset"] + at["length"]].to_pybytes()))
                    top = block.index(b"\r\n\r\n") + 4
                    size, sha = int(headers(block[:top])["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (size != len(block) - top or sha != digest(block[top:])):
                        raise ValueError(f"record {at['id']} doesn't agree with its headers")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append({"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": sha, "record_type": head["warc-type"], "refers_to": number("x-refers-to-page-id")})
                yield pa.RecordBatch.from_pylist(rows,
                    pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return _archives(spark, folder).mapInArrow(parse, RECORD_SQL)


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives under folder, normalises them, and returns what the archives say.

    Null html: an empty payload. Null url: a urn names the page. Null page_id: its record names no page. No rows: no archives.
    """
    spark = pages.sparkSession
    put(f"{folder}/archive", "_STARTED", b"")  # the folders exist even where there is nothing to write
    put(f"{folder}/raw", "_STARTED", b"")
    choose(write_archives(pages, f"{folder}/raw"), f"{folder}/raw", min_bytes)
    normalise_archives(spark, f"{folder}/raw", f"{folder}/archive")
    return read_archives(spark, f"{folder}/archive")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"), new_path(spark, "warc"))


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM h
"""
