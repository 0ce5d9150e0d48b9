"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own. The reader cuts files into byte ranges; a task scans its
range for the gzip magic, takes as a record's start only a place whose member decodes to a WARC
header and is followed by another member or the end of the file, and owns the records that start
inside its range, wherever they end.

A null payload is empty. Of pages with equal payloads of at least least_bytes, that with the
largest page_id is the response and the others are revisits of it; rows that repeat that page_id
are responses too. Archives of others are read as well: request, metadata and information records
are passed over, bodies sent in chunks are joined, resources count as responses, NUL between members
is skipped, and ids that are not ours are null. A null page_id or url gives a record without that field, read back as null. An
empty table gives an empty folder and reads back as no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.shared import new_folder, open_store, short_batches, whole_file

MAGIC = b"\x1f\x8b\x08"
ID = "urn:crestline:page:"
#: A field of our own: the url as it was, escaped, where it holds what a header line can't.
SOURCE_URI = "Crestline-Source-URI"
LEAST_BYTES = 1000
#: Bytes of a file that one task scans, and that it reads at a time.
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: A candidate member is judged by so many decoded bytes.
HEAD_BYTES = 64
MANIFEST = "file string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, digest and refers_to. Payload digests are pre-aggregated, so a payload of many pages is one row when joined."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = f"{ID}{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {digest}").urn
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        odd = [c for c in url if c <= " " or c.isspace()]
        head.append("WARC-Target-URI: " + "".join(quote(c) if c <= " " or c.isspace() else c for c in url))
        if odd:  # the field above can't say whether an escape stood in the url
            head.append(f"{SOURCE_URI}: {quote(url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of with_revisits() to path, a file for each partition, and returns a manifest, which is what sets the work going.

    A task writes under a name of its own and renames it when whole, so one that is repeated after
    a loss replaces its file and never leaves half of one under the final name.
    """
    short_batches(rows.sparkSession)
    new_folder(path)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, size, final = 0, 0, f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        with whole_file(final) as out:
            for p in parts:
                for row in p.to_pylist():
                    whole = record(**row, date=date)
                    out.write(whole)
                    n, size = n + 1, size + len(whole)
        yield pa.RecordBatch.from_pylist([{"file": final, "records": n, "bytes": size}])

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST)


class _Window:
    """Bytes of a file by place, read forward in pieces."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.base, self.held = file, size, start, bytearray()

    def upto(self, end: int) -> bytearray:
        """Reads on until the place end (or the file's end) is held."""
        end = min(end, self.size)
        if (have := self.base + len(self.held)) < end:
            self.file.seek(have)
            self.held += self.file.read(max(end - have, READ_BYTES))
        return self.held

    def drop(self, before: int) -> None:
        del self.held[: before - self.base]
        self.base = before


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that starts at the place and where it ends, or None if none does."""
    decode, out, place = zlib.decompressobj(31), [], at
    try:
        while not decode.eof:
            held = window.upto(place + 1)
            piece = bytes(held[place - window.base : place - window.base + READ_BYTES])
            if not piece:
                return None
            out.append(decode.decompress(piece))
            if len(out) == 1 and len(out[0]) >= HEAD_BYTES and not out[0].startswith(b"WARC/1."):
                return None
            place += len(piece)
    except zlib.error:
        return None
    whole, end = b"".join(out), place - len(decode.unused_data)
    if not whole.startswith(b"WARC/1."):
        return None
    # between members some writers pad with NUL
    while (pad := window.upto(end + 1)[end - window.base : end - window.base + 1]) == b"\0":
        end += 1
    after = window.upto(end + 3)[end - window.base : end - window.base + 3]
    return (whole, end) if not pad or after == MAGIC else None


def members(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records that start in [start, end)."""
    window, at, known = _Window(file, size, start), start, False
    while at < min(end, size):
        if not known:
            held = window.upto(min(end, at + READ_BYTES) + 2)
            k = held.find(MAGIC, at - window.base)
            if k < 0:
                at = max(at + 1, window.base + len(held) - 2)
                window.drop(at)
                continue
            at = window.base + k
            if at >= end:
                return
        got = _member(window, at)
        if got is None:
            at, known = at + 1, False
            continue
        yield got[0]
        at, known = got[1], True
        window.drop(at)


def _plain(http: bytes, body: bytes) -> bytes:
    """The body of an HTTP message, its chunks joined if it was sent in chunks."""
    if not re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", http):
        return body
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            break
        if not n:
            break
        out.append(body[line + 2 : line + 2 + n])
        at = line + 4 + n
    return b"".join(out)


def parsed(whole: bytes) -> dict | None:
    """Fields of a decoded record, its payload among them (None for revisits); None for what holds no page: records of other types."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit", "resource"):
        return None
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    http, payload = (b"", block) if kind == "resource" or not block.startswith(b"HTTP/") else (block.partition(b"\r\n\r\n")[i] for i in (0, 2))
    payload = _plain(http, payload)
    name, refers = fields.get("warc-record-id", "").strip("<>"), fields.get("warc-refers-to", "").strip("<>")
    said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit, url = kind == "revisit", fields.get("warc-target-uri", "").strip("<>") or None
    if SOURCE_URI.lower() in fields:
        url = unquote(fields[SOURCE_URI.lower()])
    elif "warc-target-uri" in fields and url is None:
        url = ""
    number = lambda x: int(x[len(ID) :]) if x.startswith(ID) and x[len(ID) :].lstrip("-").isdigit() else None
    return {
        "page_id": number(name), "url": url, "payload": None if revisit else payload,
        "payload_bytes": (int(said[1]) if said else None) if revisit else len(payload), "payload_digest": (base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower() or None) if revisit else hashlib.sha1(payload).hexdigest(),
        "record_type": "revisit" if revisit else "response", "refers_to": number(refers),
    }


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """The records of all *.warc.gz files below path. Files are listed by Spark and dealt out by byte range."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split(" ") for x in schema.split(", "))])
        for p in parts:
            for task in p.to_pylist():
                store, local = open_store(task["path"])
                with store.open_input_file(local) as file:
                    rows = []
                    for whole in members(file, task["length"], task["start"], task["start"] + range_bytes):
                        if (row := parsed(whole)) is not None:
                            rows.append(row)
                        if len(rows) == 200:
                            yield pa.RecordBatch.from_pylist(rows, schema=shape)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)

    schema = RECORDS + (", payload binary" if payloads else "")
    return dealt.mapInArrow(read, schema)


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Writes the pages to archives below path and reads their records back."""
    spark = pages.sparkSession
    if not write_archives(with_revisits(pages), path).agg(F.sum("records")).first()[0]:
        return spark.createDataFrame([], RECORDS)
    return read_archives(spark, path)
