"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256 (with SHA-1 and length as part of the key), in a Parquet table bucketed by that digest; the exact header
blocks are stored apart: those of responses bucketed alike, so the join of the two that rebuilds the records moves no payload, those of revisits, of which a
payload may have any number, as they come. The rebuilt records are written as .warc.gz files of some FILE_BYTES: a response has its payload, a revisit only headers that refer
to the response. The reader takes nothing but these files: it parts the records by their Content-Length, as the format defines, so no byte of a payload can pass for the end of a record;
it parses the headers, holds lengths and digests against the payload bytes, and looks up a revisit's response by the digest in its header. A file that does not end
with a record's end, or another number of records than were written, raises an error.

Equal payloads meet in a map-side aggregate, so a hot payload crosses the network once for each task; records carry only digests to
the other joins, where salt deals those of a hot payload to several tasks. A file is read by one task, record by record.

Defined results: a null html is an empty payload, a null url an empty target; equal payloads have one response, the smallest
page_id's (rows that repeat that page_id and payload are all marked response; a null page_id is the smallest only of its like); a very long payload is one
record, whole, and the file that holds it as much longer; an empty table gives an empty archive; ids may be integers or strings; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, materialize, read_table, salted_join, scratch_path, text_of

#: Fixed values of the WARC 1.1 format.
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
VERSION = "WARC/1.1"

#: Payload bytes of a bucket, and so about of a file before compression, at which buckets outnumber the shuffle partitions.
FILE_BYTES = 64 << 20
#: Compressed bytes that the reader unpacks at a time; records that it hands on at a time.
READ_BYTES = 1 << 16
RECORDS = 256


def base32_of_hex(hexa: Column) -> Column:
    """Upper-case base32 without padding of the 40 hex digits of a SHA-1: five hex digits make four of base32."""
    part = lambda i: F.lpad(F.conv(F.substring(hexa, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_uri(page_id: Column) -> Column:
    """A record id that follows from the page_id, so that a task that runs again writes the same record."""
    return F.concat(F.lit("<urn:page:"), F.url_encode(F.coalesce(page_id.cast("string"), F.lit(""))), F.lit(">"))


def page_of(uri: Column, kind: str) -> Column:
    """The page_id of a record_uri(), null of an empty one."""
    return F.url_decode(F.nullif(F.regexp_extract(uri, "^<urn:page:(.*)>$", 1), F.lit(""))).cast(kind)


def first_lines(archive_id: str) -> str:
    """What each record of an archive begins with."""
    return f"{VERSION}{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive_id}>{CRLF}"


def _header(kind: Column, archive_id: str) -> Column:
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = kind == "revisit"
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    refers = F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", record_uri(F.col("first_id"))))).otherwise(F.lit(""))
    # a line break in a url would end its header line
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    return F.concat(
        F.lit(first_lines(archive_id)), line("WARC-Type", kind), line("WARC-Record-ID", record_uri(F.col("page_id"))), line("WARC-Date", F.lit(WARC_DATE)), line("WARC-Target-URI", url), refers,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit(CRLF), http,
    )


def write_store(pages: DataFrame, path: str, archive_id: str, min_bytes: int = 0) -> tuple[str, str, str]:
    """Writes path/payloads (sha256, payload), path/responses and path/revisits (page_id, sha256, record_type, header), and returns their table names.

    Payloads of fewer than min_bytes are stored once too, but their records are all responses.
    """
    spark = pages.sparkSession
    total = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))
    rec = pages.select("page_id", F.col("url").cast("string").alias("url"), text_of("html").cast("binary").alias("payload"))
    rec = rec.select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1_hex"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    key = ["sha256", "sha1_hex", "payload_bytes"]
    folders = ("payloads", "responses", "revisits")
    names = tuple(f"warc_{kind}_{archive_id.replace('-', '')}" for kind in folders)

    def save(df: DataFrame, k: int) -> None:
        df.repartition(buckets, "sha256").write.bucketBy(buckets, "sha256").sortBy("sha256").option("path", f"{path}/{folders[k]}").option("compression", "zstd").saveAsTable(names[k])

    # the map-side half of the aggregate and the shuffle are the repartition's; the other half meets its rows in place
    save(rec.groupBy("sha256").agg(F.first("payload").alias("payload")), 0)
    light = rec.drop("payload")
    owners = light.groupBy(*key).agg(F.min("page_id").alias("first_id"))
    kind = F.when((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), "revisit").otherwise("response")
    records = salted_join(light, owners, key).withColumn("sha1", base32_of_hex(F.col("sha1_hex")))
    records = materialize(records.select("page_id", "sha256", kind.alias("record_type"), _header(kind, archive_id).alias("header")), "warc-headers")
    save(records.filter("record_type = 'response'"), 1)
    records.filter("record_type = 'revisit'").write.option("path", f"{path}/{folders[2]}").option("compression", "zstd").saveAsTable(names[2])
    return names


def rebuild(spark: SparkSession, payloads: str, responses: str, revisits: str) -> DataFrame:
    """The original records of a store: page_id, record_type, header, payload (null of a revisit, which has none)."""
    stored = spark.table(payloads).withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256"))).cast("binary")))
    whole = spark.table(responses).join(stored, "sha256").select("page_id", "record_type", "header", "payload")
    return whole.unionByName(spark.table(revisits).select("page_id", "record_type", "header", F.lit(None).cast("binary").alias("payload")))


def export_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC part files of rebuild()'s records: Spark's text writer puts the two line ends after each record."""
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    records.select(F.concat("header", body).alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Stores pages under path, writes path/warc from the store, and path/written with the number of its records, and returns the archive's id."""
    archive_id = str(uuid.uuid4())
    spark = pages.sparkSession
    names = write_store(pages, path, archive_id, min_bytes)
    try:
        export_warc(rebuild(spark, *names), f"{path}/warc")
        held = [spark.table(name).groupBy().count() for name in names[1:]]
        held[0].unionByName(held[1]).agg(F.sum("count").alias("records")).write.parquet(f"{path}/written")
    finally:
        for name in names:  # the files stay; the names belong to this session
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return archive_id


class _Unpacked(io.RawIOBase):
    """The bytes of a file of gzip members, unpacked READ_BYTES of it at a time; of a plain file its own bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.packed = memoryview(raw), 0, raw[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.packed else None
        self.more = b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.more and self.at < len(self.raw):
            part = self.raw[self.at : self.at + READ_BYTES]
            self.at += len(part)
            if self.packed:
                self.more = self.member.decompress(part)
                if self.member.eof:
                    self.at -= len(self.member.unused_data)
                    self.member = zlib.decompressobj(31)
            else:
                self.more = part
        n = min(len(into), len(self.more))
        into[:n], self.more = self.more[:n], self.more[n:]
        return n


def records_of(raw: bytes):
    """(header, block) of each record of a WARC file, parted by Content-Length."""
    source = io.BufferedReader(_Unpacked(raw), 1 << 16)
    while line := source.readline():
        header, length = [line], None
        while (line := source.readline()) not in (b"\r\n", b""):
            header.append(line)
            name, _, value = line.partition(b":")
            if name.lower() == b"content-length":
                length = int(value)
        block = source.read(length) if length is not None else b""
        if not header[0].startswith(b"WARC/") or length is None or len(block) < length or source.read(4) != b"\r\n\r\n":
            raise ValueError(f"no whole record at {header[0][:80]!r}")
        yield b"".join(header), block


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """A row for each record of the .warc or .warc.gz files of a folder: page_id, record_type, refers_to, header, payload (null of revisits), payload_digest as in the header.

    A file's bytes are read by one task, which unpacks them as it goes: it holds the packed file and a few records.
    """
    byte_batches(spark)

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                held, size = [], 0
                for record in records_of(raw.as_py()):
                    held.append(record)
                    size += len(record[1])
                    if len(held) == RECORDS or size >= READ_BYTES << 5:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], ["header", "block"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], ["header", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,warc}*").load(path).select("content")
    parts = files.mapInArrow(run, "header binary, block binary").select(F.col("header").cast("string").alias("header"), "block")
    field = lambda name: F.regexp_extract("header", f"(?i)\r\n{name}: ([^\r\n]*)\r\n", 1)
    # the payload stands behind the first empty line of the block
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), CRLF + CRLF, 1)) + 4
    return parts.select(
        page_of(field("WARC-Record-ID"), id_type).alias("page_id"), field("WARC-Type").alias("record_type"), F.when(field("WARC-Type") == "revisit", page_of(field("WARC-Refers-To"), id_type)).alias("refers_to"),
        "header", F.when(field("WARC-Type") == "response", F.col("block").substr(http + 1, F.octet_length("block"))).alias("payload"), F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:([A-Z2-7]{32})$", 1).alias("payload_digest"),
    )


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """check_payloads() of the files that write_archive() wrote to path; another number of records than it wrote raises an error."""
    return check_payloads(read_warc(spark, f"{path}/warc", id_type), spark.read.parquet(f"{path}/written").first()["records"])


def check_payloads(records: DataFrame, expected: int | None = None) -> DataFrame:
    """read_warc()'s records with the length and digest of each payload: a response's taken from its bytes, and held against its header; a revisit's those of the response that its header's digest names.
    expected: how many records there must be."""
    fresh = F.when(base32_of_hex(F.sha1("payload")) == F.col("payload_digest"), F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("payload of another digest: "), F.col("header"))).cast("long"))
    light = materialize(records.select("page_id", "record_type", "refers_to", "payload_digest", F.when(F.col("record_type") == "response", fresh).alias("payload_bytes")), "warc-records")
    if expected is not None and (found := light.count()) != expected:
        raise ValueError(f"{expected} records were written, {found} are in the files")
    known = light.filter("record_type = 'response'").groupBy("payload_digest").agg(F.first("payload_bytes").alias("bytes"))
    again = salted_join(light.filter("record_type = 'revisit'").drop("payload_bytes"), known, ["payload_digest"], "left").withColumnRenamed("bytes", "payload_bytes")
    return light.filter("record_type = 'response'").unionByName(again)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = read_table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    write_archive(pages, path)
    out = read_archive(spark, path, pages.schema["page_id"].dataType.simpleString())
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
r AS (SELECT page_id, h, first_id, sha1(h) AS x FROM p JOIN f USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
