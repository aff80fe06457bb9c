"""Operator 6: a deterministic, sharded writer of WARC archives, and their reader.

Records are range-sorted by page_id (ranges follow from the rows alone), each range is written in order as it is read, and a
file is closed when its compressed size passes a limit, record by record, with no file held in memory; a range holds several files' worth, so that only its last file
ends with the range.  Headers, record ids and digests are made anew from the record; dates are a parameter.  A file is
written under a temporary name and renamed when complete, and a manifest lists the files, so an attempt that is
repeated writes the same bytes under the same names.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is a response and the
others are revisits of it (equal page_ids with equal payloads: all responses).  Null payloads count as empty; a null
page_id stays null, comes first, and is never referred to; rows with one page_id stand in the order of a hash of
their payloads, and may fill many ranges; ids may lie as far apart as they can; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import files
from vellum.llm.shared import MB, drop, fresh, in_ranges, join_counted, order_key, ranges, written

SPACE = uuid.UUID("5b0c4d1e-7f0b-4d5e-9a77-1f2b6c3d4e5f")
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One record, not compressed."""
    digest = _sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block += payload if refers_to is None else b""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    block = f"software: vellum\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member without time or name, so that equal records are equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, path: str, roll_bytes: int = 4 * MB, range_bytes: int = 32 * MB, least: int = 1000, date: str = DATE, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Writes the archives of pages under path and returns the manifest (range, name, records, bytes, sha256)."""
    pages = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column), F.lit("")).alias("payload"))
    pages = pages.withColumn("key", order_key(F.col("page_id"), F.col("payload")))
    narrow = written(pages.select("page_id", "key", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), (F.octet_length("payload") + 512).cast("long").alias("size")), "digests")
    cuts = ranges(narrow, range_bytes)
    large = narrow.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    copies = written(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    # a row without a payload goes before the pages of its key and says what they refer to
    none = F.lit(None).cast("string")
    visits = join_counted(large, copies, ["digest"], "n", narrow.count()).filter("page_id < refers_to").select("page_id", none.alias("url"), none.alias("payload"), "key", "digest", "refers_to").distinct()
    rows = visits.unionByName(pages.withColumns({"digest": none, "refers_to": F.lit(None).cast("long")}))
    rows = in_ranges(rows, cuts).sortWithinPartitions("key", F.col("digest").asc_nulls_last(), "payload", "url")

    def run(batches):
        number, refer, archive = 0, {}, None
        made = 0

        def archived(name: str, first: bytes):
            """Takes the records of a file one by one, and None at its end; gives the compressed size so far, and then the file's row."""
            seen, total, n, data = hashlib.sha256(), 0, 0, member(info(name, date)) + first
            with files.committed(f"{path}/{name}") as f:
                while data is not None:
                    f.write(data)
                    seen.update(data)
                    total, n = total + len(data), n + 1
                    data = yield total
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([n]), pa.array([total]), pa.array([seen.hexdigest()])], ["range", "name", "records", "bytes", "sha256"])

        for batch in batches:
            for i, url, payload, digest, to, number in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "range")), strict=True):
                i, url, digest, number = i.as_py(), url.as_py(), digest.as_py(), number.as_py()
                if digest is not None:
                    refer = {k: v for k, v in refer.items() if k[0] == i} | {(i, digest): to.as_py()}
                    continue
                data = payload.as_py().encode()
                data = member(record(i, url, data, refer.get((i, hashlib.sha1(data).hexdigest())), date))
                if archive is None:
                    archive = archived(f"pages-{number:07d}-{made:04d}.warc.gz", data)
                    made, size = made + 1, next(archive)
                else:
                    size = archive.send(data)
                if size >= roll_bytes:
                    yield archive.send(None)
                    archive = None
        if archive is not None:
            yield archive.send(None)

    spark = pages.sparkSession
    found = rows.select("page_id", "url", "payload", "digest", "refers_to", "range").mapInArrow(run, "range int, name string, records long, bytes long, sha256 string")
    found.write.parquet(f"{path}/_manifest")
    drop(narrow, copies)
    return spark.read.parquet(f"{path}/_manifest")


def members(more: Callable[[], bytes]) -> Iterator[bytes]:
    """The gzip members of a file, one at a time; more() gives its next bytes, and none at its end."""
    data = more()
    while data:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                raise ValueError("a member ends early")
            out.append(z.decompress(data))
            data = z.unused_data or more()
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id) of all records in the manifest's files.

    Tasks open the files that the manifest names, so that no folder is listed, and read them in pieces, so that archives may be of any size.
    Digests of responses are computed from the payload and must agree with the header; those of revisits come from theirs.
    """
    manifest = spark.read.parquet(f"{path}/_manifest")

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])
        for batch in batches:
            for name, whole in zip(batch.column("name").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                seen, rows = hashlib.sha256(), []
                with files.opened(f"{path}/{name}") as f:

                    def more(f=f, seen=seen) -> bytes:
                        data = f.read(1 << 20)
                        seen.update(data)
                        return data

                    for m in members(more):
                        if x := _row(*parse(m)):
                            rows.append(x)
                        if len(rows) >= 4096:
                            yield made(rows)
                            rows = []
                if seen.hexdigest() != whole:
                    raise ValueError(f"{name} differs from the manifest")
                if rows:
                    yield made(rows)

    count = (manifest.agg(F.max("range")).first()[0] or 0) + 1
    found = manifest.select("name", "sha256", "range").repartitionById(count, "range")
    return found.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def _row(headers: dict[str, str], block: bytes):
    kind = headers["WARC-Type"]
    if kind == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(headers[k]) if k in headers else None
    return number("X-Page-ID"), headers["WARC-Target-URI"], size, digest, kind, number("X-Refers-To-Page-ID"), headers["WARC-Record-ID"]


def write_and_read(pages: DataFrame) -> DataFrame:
    path = fresh(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["members", "parse", "read", "record", "write", "write_and_read"]
