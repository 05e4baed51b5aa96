"""Operator 5: WARC archives by way of a chunked record table.

Records are written as gzip members of archive files in the shared folder and read back as a table of
chunks: (record, chunk number, bytes, digest so far). A payload larger than a chunk is never held
whole on reading; the digest grows with each chunk and the last one carries the payload's.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, long_id, read_table, ship_package

CHUNK = 1 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, from RFC 4122
DATE = "2026-01-01T00:00:00Z"


def record_urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}')}>"


def base32_of_hex(hex_digest):
    """Upper-case base32 of a column of SHA-1 hex digests, five hex digits to four letters at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        n = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, (F.shiftright(n, 15 - 5 * j).bitwiseAND(31) + 1), F.lit(1)) for j in range(4)]
    return F.concat(*parts)


def header_block(fields: list[tuple[str, object]], first: str) -> bytes:
    """A header: CR and LF in a value would break it, so they become spaces."""
    lines = [first, *(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"


def _fs(uri: str):
    """The file system of a path in the shared folder, and the path there: local, hdfs, s3, gs and abfs addresses."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri("s3://" + rest if colon and scheme in ("s3a", "s3n") else uri)


def plan_records(pages: DataFrame, id_col: str, html_col: str, url_col: str, least: int) -> DataFrame:
    """Per page: id, url, payload, digest, and the page it refers to where an earlier one has its payload.

    Which page refers to which is found on ids and digests alone; payloads meet only the pages that refer to others, by id, so a
    payload of very many pages is no hot key, and where such pages are few no payload crosses a shuffle.
    """
    payload = F.coalesce(F.encode(F.col(f"`{html_col}`"), "UTF-8"), F.lit(b""))
    rows = pages.select(long_id(pages, id_col).alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    slim = rows.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    refer = slim.join(firsts, "digest").filter("page_id <> refers_to").distinct()
    joined = rows.join(refer, ["page_id", "digest"], "left")
    return joined.select("page_id", "url", "payload", base32_of_hex(F.hex("digest")).alias("digest"), "refers_to")


def write_warc(planned: DataFrame, folder: str) -> DataFrame:
    """Archives in ``folder``, a file a task; (path, records, bytes) of those of finished tasks.

    A repeated task writes a file of its own, and only a finished task's row names its file.
    """
    ship_package(planned.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        t = TaskContext.get()
        name = f"{folder}/part-{t.partitionId():06d}-{t.taskAttemptId()}.warc.gz"
        out, records, size = None, 0, 0
        for b in batches:
            for page, url, payload, digest, refers in zip(*b.columns):
                if out is None:
                    system, path = _fs(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                page, url, digest, refers = page.as_py(), url.as_py(), digest.as_py(), refers.as_py()
                body = memoryview(payload.as_buffer())
                kind = "response" if refers is None else "revisit"
                http = header_block([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(body))], "HTTP/1.1 200 OK")
                head = header_block(
                    [
                        ("WARC-Type", kind),
                        ("WARC-Record-ID", record_urn(page)),
                        ("WARC-Date", DATE),
                        ("WARC-Target-URI", url),
                        ("WARC-Payload-Digest", f"sha1:{digest}"),
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers is not None else None),
                        ("WARC-Refers-To", record_urn(refers) if refers is not None else None),
                        ("X-Page-Id", page),
                        ("X-Refers-To-Page", refers),
                        ("Content-Type", "application/http; msgtype=response"),
                        ("Content-Length", len(http) + (len(body) if refers is None else 0)),
                    ],
                    "WARC/1.1",
                )
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                parts = [head, http, *(body[k : k + CHUNK] for k in range(0, len(body) if refers is None else 0, CHUNK)), b"\r\n\r\n"]
                for part in parts:
                    if data := z.compress(part):
                        size += out.write(data) or len(data)
                data = z.flush()
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [records], "bytes": [size]})

    return planned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")


class _Stream:
    """The inflated bytes of a file of gzip members (or a plain one), read a bounded piece at a time."""

    def __init__(self, raw):
        self.raw, self.held, self.at, self.z, self.rest, self.plain = raw, b"", 0, None, b"", None

    def _more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(CHUNK)
            self.rest = b""
            if not data:
                return False
            if self.plain is None:
                self.plain = data[:2] != b"\x1f\x8b"
            if not self.plain:
                if self.z is None or self.z.eof:
                    self.z = zlib.decompressobj(31)
                got = self.z.decompress(data, CHUNK)
                self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
                data = got
            if data:
                self.held, self.at = self.held[self.at :] + data, 0
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """Through ``mark``; None at the end of the file."""
        while (end := self.held.find(mark, self.at)) < 0:
            if len(self.held) - self.at > most:
                raise ValueError("a header of over a MB")
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends inside a header")
                return None
        out, self.at = self.held[self.at : end], end + len(mark)
        return out

    def take(self, n: int):
        """``n`` bytes in pieces of at most a chunk."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends inside a record")
            out = self.held[self.at : self.at + min(n, CHUNK)]
            self.at += len(out)
            n -= len(out)
            yield out


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


CHUNKS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "record_type", "uri")]
    + [T.StructField(n, T.LongType()) for n in ("page_id", "refers_to", "chunk", "bytes_so_far")]
    + [T.StructField("last", T.BooleanType()), T.StructField("digest_so_far", T.StringType()), T.StructField("declared_digest", T.StringType())]
    + [T.StructField("declared_bytes", T.LongType()), T.StructField("data", T.BinaryType())]
)


def read_warc(files: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives named in ``files.path``: a row per chunk of a payload, one at least a record.

    ``digest_so_far`` is the base32 SHA-1 of the payload through this chunk, so on the ``last`` row it is the
    payload's. A revisit has no payload in the archive; its row carries what its header declares. Chunks of a
    record stand in order in one task, and a task holds one chunk. ``with_data=False`` leaves the bytes out.
    """
    ship_package(files.sparkSession)
    names = CHUNKS.fieldNames()

    def rows_of(path):
        system, at = _fs(path)
        with system.open_input_stream(at) as raw:
            s = _Stream(raw)
            while True:
                head = s.until(b"\r\n\r\n")
                if head is None:
                    return
                f = _fields(head)
                number = lambda k, f=f: int(f[k]) if k in f and f[k] not in ("", "None") else None
                left = int(f["content-length"])
                http = s.until(b"\r\n\r\n")
                left -= len(http) + 4
                declared = int(_fields(http).get("content-length", left))
                base = [f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page")]
                digest, seen, k = hashlib.sha1(), 0, 0
                said = (f.get("warc-payload-digest", "").partition(":")[2] or None, declared)
                so_far = lambda digest=digest: base64.b32encode(digest.copy().digest()).decode()
                if not left:
                    yield (*base, 0, 0, True, so_far(), *said, b"" if with_data else None)
                while seen < left:
                    data = b"".join(s.take(min(CHUNK, left - seen)))
                    digest.update(data)
                    seen += len(data)
                    yield (*base, k, seen, seen == left, so_far(), *said, data if with_data else None)
                    k += 1
                for _ in s.take(4):
                    pass

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(CHUNKS)
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(path):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) >= 4096 or size >= 8 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], names=names)

    return files.select("path").mapInArrow(run, CHUNKS)


def warc_round_trip(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least: int = 0, scratch: Scratch | None = None
) -> DataFrame:
    """Per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Ids are of an integer type. Of pages with equal payloads of ``least`` bytes or more the smallest id is the response (with it any
    repeated row of that id), the others are revisits of it. A null html is an empty payload, a null url is left out; a null id is
    never a response's partner and has a response of its own. Very large payloads are written and read a chunk at a time. Bytes and
    digest of a response are computed while reading and must equal its header's, or the read fails. An empty table gives an empty
    result. Other columns are ignored, whatever their names. Archives stay in the shared folder.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    files = scratch.table(write_warc(plan_records(pages, id_col, html_col, url_col, least), scratch.path("archives")), "files")
    n = max(1, files.count())
    records = read_warc(files.repartition(n), with_data=False).filter("last")
    response = F.col("record_type") == "response"
    wrong = response & ((F.col("digest_so_far") != F.col("declared_digest")) | (F.col("bytes_so_far") != F.col("declared_bytes")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("string"))
    return records.select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.coalesce(checked, F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest"))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))
