"""WARC 1.1 archives with revisits.

Headers alone are shuffled by payload digest; every record with a payload seen before joins the first response with it and
becomes a revisit. The archives are written by Spark's text writer, one record a row: a record ends in CRLF CRLF, of which
the writer's line separator is the second.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import new_path, small, stash

CRLF = "\r\n"
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of payloads in one file, about; a reader holds one file at a time.
FILE_BYTES = 32 << 20
#: Originals that have copies; up to so many are broadcast, beyond it a shuffle joins them.
ORIGINALS_BROADCAST = 200_000

READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sha1_base32(payload):
    """Bare upper-case base32 of the SHA-1 of a binary column: 20 bits, or 4 letters, from 5 hex digits."""
    digest, letters = F.sha1(payload), F.lit(BASE32)

    def four(i):
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return F.concat(*(letters.substr(F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.concat(*map(four, range(8)))


def resolved(headers: DataFrame, least: int = 0) -> DataFrame:
    """Originals that have copies: payload_digest, original, original_url, from page_id, url, payload_digest, payload_bytes.

    The smallest page_id of a payload is its original. Partial minima come before the shuffle, so a payload that a third of
    all records share costs a row for each task.
    """
    first = F.min(F.struct("page_id", "url")).alias("first")
    groups = headers.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").select("payload_digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url"))


def records(pages: DataFrame, originals: DataFrame, date: str, least: int = 0) -> DataFrame:
    """One text a page: a response with its payload, or a revisit with headers only."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", " ")
    x = pages.join(originals, "payload_digest", "left")
    revisit = F.coalesce((F.col("original") != F.col("page_id")) & (F.col("payload_bytes") >= least), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("Content-Type", F.lit("application/http;msgtype=response")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("original"))), line("WARC-Refers-To-Target-URI", clean(F.col("original_url"))), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit(CRLF),
    )
    return x.select(F.concat(head, body, F.lit(CRLF)).alias("value"))


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0) -> None:
    """Write page_id, url, html as deduplicated archives into the folder path.

    Null html is an empty payload, a null url an empty one. A row without a page_id is always a response; of repeated rows
    with the smallest page_id each is a response. An empty table writes no record.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    tagged = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), sha1_base32(F.encode(payload, "UTF-8")).alias("payload_digest"))
    headers = stash(tagged.drop("payload"), "warc_headers")
    n, size = headers.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    originals = small(stash(resolved(headers, least), "warc_originals"), ORIGINALS_BROADCAST)
    each = max(1, int(FILE_BYTES * n / size)) if size else 100_000
    records(tagged, originals, date, least).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def _inflated(content: memoryview) -> Iterator[bytes]:
    """Chunks of the content; gzip members, if any, are decompressed."""
    if bytes(content[:2]) != b"\x1f\x8b":
        yield bytes(content)
        return
    at, d = 0, zlib.decompressobj(31)
    while at < len(content) or d.unconsumed_tail:
        piece = d.unconsumed_tail or bytes(content[at : at + (1 << 18)])
        if not d.unconsumed_tail:
            at += len(piece)
        yield d.decompress(piece, 1 << 20)
        if d.eof:
            rest = d.unused_data
            at -= len(rest)
            d = zlib.decompressobj(31)


def parse(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of an archive's records, by Content-Length."""
    chunks, buffer = _inflated(content), bytearray()

    def more(n: int = 0, mark: bytes = b"") -> int:
        while len(buffer) < n or mark and buffer.find(mark) < 0:
            piece = next(chunks, None)
            if piece is None:
                return -1
            buffer.extend(piece)
        return buffer.find(mark) if mark else n

    while True:
        while (more(2) >= 0 or len(buffer)) and buffer[:1] in (b"\r", b"\n"):
            del buffer[:1]
        end = more(mark=b"\r\n\r\n")
        if end < 0:
            if buffer.strip():
                raise ValueError("an archive ends within a record's headers")
            return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        del buffer[: end + 4]
        n = int(headers["content-length"])
        if more(n) < 0:
            raise ValueError("an archive ends within a record's block")
        yield headers, bytes(buffer[:n])
        del buffer[:n]


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _rows(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for cell in batch.column(0):
            out: list[tuple] = []
            held = 0
            for headers, block in parse(memoryview(cell.as_buffer())):
                http, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if found != digest:
                        raise ValueError(f"a payload's digest is {found}, its header says {digest}")
                else:  # the original's HTTP headers tell the full payload's length
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                out.append((_page(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, kind, _page(headers.get("warc-refers-to")), payload if payloads and kind == "response" else None))
                held += len(payload) if payloads else 0
                if len(out) >= 5000 or held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], schema=schema)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives in path; a revisit's payload_bytes are those of the payload that it refers to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(lambda batches: _rows(batches, payloads), READ)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as deduplicated archives and read back."""
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path := new_path(spark, "warc"))
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
