"""WARC archives: writing, reading, and revisit resolution.

Headers alone, (record, payload digest), are shuffled to choose one original of each payload; the others become
``revisit`` records without a body that refer to it.  Archives are WARC/1.1 files in which each record is a gzip member
of its own, so that readers can seek.  Spark's text writer puts them into the shared folder, which needs a separator:
the last byte of a member, the highest one of its length, is zero, and that is the separator.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup_join, sized

CRLF = "\r\n"
#: Ends a record.
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive file, about; a larger record stands alone.
FILE_BYTES = 16 << 20


def payload_headers(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with row_key, payload_bytes and payload_digest (bare upper-case base32 SHA-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = [], []
            for x in batch.column("html"):
                raw = (x.as_py() or "").encode()
                digests.append(base64.b32encode(hashlib.sha1(raw).digest()).decode())
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("html"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["page_id", "url", "html", "payload_bytes", "payload_digest"])

    return pages.mapInArrow(run, "page_id bigint, url string, html string, payload_bytes bigint, payload_digest string")


def record_id(page_id: Column, digest: Column) -> Column:
    """A URN that page and payload decide, so that a task which runs again writes the same record."""
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), digest))
    part = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def resolve(headers: DataFrame) -> DataFrame:
    """(page_id, payload_digest) with the digest's ``original``: the largest page_id that has this payload."""
    originals = headers.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    originals = Scratch(headers.sparkSession, "warc").save(originals, "originals")
    return lookup_join(headers.select("page_id", "payload_digest").distinct(), originals, "payload_digest")


def as_records(pages: DataFrame, revisits: DataFrame, date: str | Column) -> DataFrame:
    """One WARC record, as text, for each row of ``pages``: fresh headers, and the body where it is an original.

    ``revisits`` has the (page_id, payload_digest, original) of the others, each once.
    """
    own = revisits.select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), "original")
    # page ids may be null; digests never are
    joined = pages.join(own, (F.col("payload_digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page")), "left")
    revisit = F.col("r_digest").isNotNull()
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.coalesce("html", F.lit(""))))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "")
    text = F.concat(
        F.lit("WARC/1.1" + CRLF),
        head("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        head("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        head("WARC-Date", date if isinstance(date, Column) else F.lit(date)),
        head("WARC-Target-URI", uri),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(F.col("page_id").isNotNull(), head("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        F.when(revisit, F.concat(head("WARC-Profile", F.lit(PROFILE)), head("WARC-Refers-To", record_id(F.col("original"), F.col("payload_digest"))))).otherwise(F.lit("")),
        head("Content-Type", F.lit("application/http; msgtype=response")),
        head("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(END),
    )
    return joined.select(text.alias("record"))


def members(records: DataFrame) -> DataFrame:
    """Each record as a gzip member without its last byte, which is zero: that of lengths below 16 MiB.

    A longer record, whose length may end otherwise, is followed by an empty member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                made = [gzip.compress(x.as_buffer().to_pybytes(), 6, mtime=0) for x in batch.column(0).slice(i, 256)]
                made = [(m if m[-1] == 0 else m + gzip.compress(b"", mtime=0))[:-1] for m in made]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    return records.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))


def write_archives(records: DataFrame, path: str, rows: int, total_bytes: int) -> None:
    """Write ``records`` as archives of about ``FILE_BYTES`` each, where they are: bodies are not shuffled.

    The driver then renames the finished files, part-*.txt, to part-*.warc.gz.
    """
    each = max(1, rows * FILE_BYTES // max(1, total_bytes))
    members(records).write.option("lineSep", "\0").option("maxRecordsPerFile", each).text(path)
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def rename(name: str) -> None:
        old, new = (spark._jvm.org.apache.hadoop.fs.Path(folder, x) for x in (name, name.removesuffix(".txt") + ".warc.gz"))
        if not files.rename(old, new):
            raise OSError(f"{path}/{name} could not be renamed")

    names = [x.getPath().getName() for x in files.listStatus(folder)]
    with ThreadPoolExecutor(32) as pool:  # calls to a store that wait for it most of the time
        list(pool.map(rename, [x for x in names if x.endswith(".txt")]))


def unpack(raw: bytes, step: int = 1 << 12) -> Iterator[bytes]:
    """The contents of the gzip members of an archive one by one; what is left of a cut one is an error."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(raw):
                raise ValueError("an archive ends within a record")
            out.append(member.decompress(view[at : at + step]))
            at = min(len(raw), at + step)
        at -= len(member.unused_data)  # of one step, and so as short as that however long the archive is
        yield b"".join(out)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: header fields, names in lower case, and block; a broken archive is an error."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].decode().split(CRLF)
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        body = stop + 4
        end = body + int(fields["content-length"])
        if raw[end : end + 4] != END.encode():
            raise ValueError(f"the record at byte {at} does not end as it says")
        yield fields, raw[body:end]
        at = end + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: record_id, record_type, page_id, url, html (null in a revisit), digests, refers_to_id.

    ``payload_digest`` and ``payload_bytes`` of a response are computed anew from its body, which must match its header.
    """
    schema = "record_id string, record_type string, page_id bigint, url string, html string, payload_bytes bigint, payload_digest string, refers_to_id string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def rows(raw: bytes) -> Iterator[tuple]:
        for fields, block in chain.from_iterable(map(parse, unpack(raw))):
            said = fields["warc-payload-digest"].removeprefix("sha1:")
            body = size = None
            if fields["warc-type"] == "response":
                body = block.partition(b"\r\n\r\n")[2]
                size = len(body)
                if base64.b32encode(hashlib.sha1(body).digest()).decode() != said:
                    raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
                body = body.decode()
            page = fields.get("x-page-id")
            yield fields["warc-record-id"], fields["warc-type"], int(page) if page else None, fields.get("warc-target-uri"), body, size, said, fields.get("warc-refers-to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                records = rows(raw.as_py())
                while found := list(islice(records, 512)):
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content").where("length(content) > 0")
    # archives are read one at a time, so that a task holds one file and not a batch of them
    return files.mapInArrow(run, schema)


def resolve_revisits(heads: DataFrame) -> DataFrame:
    """Headers as read, those of revisits with their original's page_id (``refers_to``) and payload size, by a join."""
    common = ["page_id", "payload_digest", "record_type", "url", "record_id"]
    originals = heads.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("o_digest"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("o_bytes"))
    revisits = heads.where("record_type = 'revisit'")
    wanted = originals.join(revisits.select("refers_to_id").distinct(), "refers_to_id", "left_semi").dropDuplicates(["refers_to_id"])
    wanted = Scratch(heads.sparkSession, "warc").save(wanted, "wanted")
    met = lookup_join(revisits.drop("payload_bytes"), wanted, "refers_to_id", "left")
    right = F.col("payload_digest") == F.col("o_digest")
    met = met.select(*common, F.when(right, F.col("o_bytes")).alias("payload_bytes"), F.when(right, F.col("refers_to")).alias("refers_to"))
    own = heads.where("record_type <> 'revisit'").select(*common, "payload_bytes", F.lit(None).cast("bigint").alias("refers_to"))
    return met.unionByName(own)


def deduplicated(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write ``pages`` (page_id, url, html) to deduplicated archives below ``path``.

    Of rows with equal payloads, empty ones too, the one with the largest page_id is the response and the others are
    revisits of it; rows that repeat the largest id, and the payload, are all responses.  Null ids count as smallest
    (all responses, if no other row has their payload).  A null html is an empty payload.  ``date``, in the form
    2024-01-31T12:00:00Z, is that of all records; without one it is the time of the call.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = payload_headers(pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    scratch = Scratch(pages.sparkSession, "warc")
    slim = scratch.save(heads.select("page_id", "payload_bytes", "payload_digest"), "headers")
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum(F.col("payload_bytes") + 500), F.lit(0))).first()
    revisits = sized(scratch.save(resolve(slim).where(~F.col("page_id").eqNullSafe(F.col("original"))), "revisits"))
    write_archives(as_records(heads, revisits, date), path, rows, int(total))
    scratch.drop("headers", "revisits")


def archive_round_trip(pages: DataFrame, date: str | None = None) -> DataFrame:
    """Write ``pages`` as deduplicated archives in the shared folder, read them back and resolve the revisits.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id) for each row.
    """
    scratch = Scratch(pages.sparkSession, "archive")
    deduplicated(pages, scratch.path("warc"), date)
    heads = scratch.save(read_archives(pages.sparkSession, scratch.path("warc")).drop("html"), "heads")
    return resolve_revisits(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")
