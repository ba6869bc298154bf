"""WARC archives in seekable Zstandard bundles.

Each task writes its records to one bundle: records are grouped into independent frames of about
``frame_bytes``, and a seek table (a skippable frame with each frame's compressed and plain size and a
footer) ends the file, so any frame can be found and unpacked alone. The index maps each record's identifier
to its file, its frame and its offset within the frame.

Payloads that are equal byte for byte share a digest; the page with the largest identifier keeps the
payload as ``response`` and the others ``revisit`` it. Only digests that occur more than once are joined
back, one row each, however many copies there are: by broadcast where there are at most BROADCAST_ROWS of them, so
that no page is shuffled, else by a shuffle of the pages, whose long partitions Spark splits.

A record's identifier is made of its page's and its payload's digest, so pages that share an identifier, null
included, have records of their own unless their payloads are equal too; such records are repetitions of each other.

Cases: null and empty payload has 0 bytes; null ``page_id`` sorts below all others and a payload that only
such pages hold is written as response each time; rows repeated with the largest identifier are responses
each; null URL is written as urn:missing; a payload of any length is one record, whole; extra columns are ignored,
whatever their names; an empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files, scratch, worker

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, file string, frame long, offset long, length long, first boolean"
_INT, _STR = pa.int64(), pa.string()


#: Shared digests that may be broadcast: at about 80 bytes each, 40 MB.
BROADCAST_ROWS = 500_000


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}:{digest}"


def page_of(urn: str | None) -> int | None:
    page = urn.strip("<>").split(":")[2] if urn else "null"
    return None if page == "null" else int(page)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only, which keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._') if url else 'urn:missing'}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
    end = stop + 4 + int(fields["Content-Length"])
    return fields, data[stop + 4 : end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(f) -> list[tuple[int, int, int]]:
    """Place, compressed and plain size of each frame, by the footer."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def fetch(folder: str, file: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry; only its frame is read and unpacked."""
    store, path = files.shared(folder)
    with store.open_input_file(f"{path}/{file}") as f:
        at, packed, plain = frames_of(f)[frame]
        f.seek(at)
        fields, block, _ = parse(zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain), offset)
    return fields, block


def write_bundles(
    pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = 1 << 18, level: int = 3, date: str = "1970-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write all records; the committed index."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1(F.col("html").cast("binary"))), "bytes": F.octet_length("html")})
    digests = rows.select("page_id", "sha1", "bytes").filter(F.col("bytes") >= min_bytes)
    shared = scratch.table(digests.groupBy("sha1", "bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-shared")
    rows = rows.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, ["sha1", "bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    rows = rows.select("page_id", "url", "html", "sha1", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.starts("op10")
        index: list[tuple] = []
        begun = False
        frames: list[tuple[int, int]] = []
        held, size = [], 0
        pack = zstandard.ZstdCompressor(level=level).compress
        first = next(batches, None)
        if first is None:
            return

        def rest():
            yield first
            yield from batches

        with files.new_file(folder, f"bundle-{TaskContext.get().partitionId():06d}", ".warc.zst") as (name, out):

            def flush():
                nonlocal size
                data = b"".join(held)
                packed = pack(data)
                out.write(packed)
                frames.append((len(packed), len(data)))
                held.clear()
                size = 0

            for b in rest():
                for page, url, html, sha1, to in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                    digest = base64.b32encode(sha1).decode()
                    data = record(page, url, html.encode(), digest, to, date)
                    index.append((record_id(page, digest), page, name, len(frames), size, len(data), not begun))
                    begun = True
                    held.append(data)
                    size += len(data)
                    if size >= frame_bytes:
                        flush()
                if index:
                    yield _batch(index, [_STR, _INT, _STR, _INT, _INT, _INT, pa.bool_()], INDEX)
                    index.clear()
            if held:
                flush()
            out.write(seek_table(frames))

    return scratch.table(rows.mapInArrow(run, INDEX), "warc-index")


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Read every bundle back, frame by frame, and check each payload against its digest."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.shared(folder)
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as f:
                    for place, packed, plain in frames_of(f):
                        f.seek(place)
                        data, at, rows = unpack.decompress(f.read(packed), max_output_size=plain), 0, []
                        while at < len(data):
                            fields, block, at = parse(data, at)
                            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            head, _, payload = block.partition(b"\r\n\r\n")
                            length = int(head.rpartition(b"Content-Length: ")[2])
                            if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                                raise ValueError(f"{name}: a payload does not match its digest")
                            rows.append((page_of(fields["WARC-Record-ID"]), length, digest, kind, page_of(fields.get("WARC-Refers-To"))))
                        yield _batch(rows, [_INT, _INT, _STR, _STR, _INT], schema)

    names = index.filter("first").select("file")
    return names.repartition(max(1, names.count()), "file").mapInArrow(run, schema)


def target_uri(fields: dict[str, str]) -> str | None:
    uri = fields["WARC-Target-URI"]
    return None if uri == "urn:missing" else unquote(uri)


#: What reading the archives back gives, in DuckDB's SQL over ``pages``: base32 is four letters for five hexadecimal digits.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, payload_bytes, max(page_id) AS winner FROM p GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT p.*, winner, CASE WHEN page_id IS DISTINCT FROM winner THEN winner END AS refers_to,
    list_transform(range(0, 8), lambda k: CAST('0x' || substring(p.h, 5 * k + 1, 5) AS BIGINT)) AS fives FROM p LEFT JOIN w ON w.h = p.h AND w.payload_bytes = p.payload_bytes)
SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM d
"""
