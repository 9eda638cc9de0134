"""WARC archives: writing, the normaliser of monolithic gzip files, and reading by an offset index.

Spark's text writer makes one gzip stream of a whole file, in which no record can be reached on its own. The normaliser
inflates such a stream once, from front to back, writes every record as a gzip member of its own, and leaves an offset
index beside the archive. Archives then read record by record, or from any offset.
"""

from __future__ import annotations

import base64
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_folder

#: Payloads under so many bytes never become revisits.
LEAST_SHARED = 1000
BLOCK = 1 << 20
END = b"\r\n\r\n"


def decided(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """pages with payload_digest (hex SHA-1), payload_bytes, record_type and refers_to.

    Of equal payloads of at least `least` bytes the row with the largest id is the response (each of them, if that id
    repeats or all are null); the others revisit it. A null body is an empty one. Other columns pass through; one that has
    a name of those that are added raises.
    """
    if own := {"payload_digest", "payload_bytes", "record_type", "refers_to", "_holder", "_n"} & {c.lower() for c in pages.columns}:
        raise ValueError(f"columns of pages can't be named {sorted(own)}")
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    known = pages.withColumn("payload_digest", F.sha1(body)).withColumn("payload_bytes", F.octet_length(body).cast("long"))
    groups = known.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max(id_col).alias("_holder"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    groups = cut(groups)  # a plain table: adaptive execution can then split a payload that many pages share
    joined = known.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisits = F.col("_holder").isNotNull() & ~F.col("_holder").eqNullSafe(F.col(id_col))
    return joined.select(*(F.col(f"`{c}`") for c in pages.columns), "payload_digest", "payload_bytes", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("_holder")).alias("refers_to"))


def _record_urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def records(decided_pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): the text of one WARC record per row, without the two line ends that close it. Control characters of URLs become spaces."""
    n = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
    response = F.col("record_type") == "response"
    block = F.when(response, F.concat(http, F.coalesce(F.col(body_col), F.lit("")))).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _record_urn(F.col(id_col)),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"\p{Cntrl}", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nWARC-Payload-Length: "), n,
        F.when(response, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_urn(F.col("refers_to")))),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return decided_pages.select(F.concat(head, block).alias("value"))


def write_monolithic(values: DataFrame, folder: str, records_per_file: int = 20_000) -> None:
    """Writes records to gzip files that are one stream each, in the folder, by Spark's text writer."""
    values.write.option("compression", "gzip").option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).text(folder)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        uri = unquote("/" + uri[5:].lstrip("/"))
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def inflated(stream: BinaryIO) -> Iterator[bytes]:
    """What a gzip file holds, member after member, in blocks; the file is read once and no more than a block is held."""
    member = zlib.decompressobj(31)
    begun = False
    while raw := stream.read(BLOCK):
        while raw:
            begun = True
            out = member.decompress(raw, 4 * BLOCK)
            if out:
                yield out
            if member.eof:
                raw, member, begun = member.unused_data, zlib.decompressobj(31), False
            else:
                raw = member.unconsumed_tail
    if begun:
        if tail := member.flush():
            yield tail
        if not member.eof:
            raise ValueError("the gzip stream ends too early")


def split_records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, head, block) of each WARC record; no more than a record and a block are held."""
    held = bytearray()

    def more() -> bool:
        b = next(blocks, None)
        if b is not None:
            held.extend(b)
        return b is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        if len(held) < 2:
            if more():
                continue
            if held:
                raise ValueError("bytes after the last record")
            return
        start = 0
        while (end := held.find(END, start)) < 0:
            start = max(0, len(held) - 3)
            if not more():
                raise ValueError("a record has no end of its headers")
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(headers["content-length"])
        while len(held) < stop + 4:
            if not more():
                break
        if len(held) < stop:
            raise ValueError("a record is cut off")
        yield headers, bytes(held[: end + 4]), bytes(held[end + 4 : stop])
        del held[:stop]


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise_file(source: str, target: str) -> tuple[int, int]:
    """Rewrites the archive at source with a member per record to target, and its index to target + '.idx'. Returns (records, bytes).

    Index lines: offset, length of the member, type, record id, payload digest, separated by tabs. Both files get their names when they are
    whole, so a task that runs twice leaves whole files.
    """
    fs, path = _filesystem(source)
    out_fs, out_path = _filesystem(target)
    own = uuid.uuid4().hex
    offset = n = 0
    with fs.open_input_stream(path, compression=None) as raw, out_fs.open_output_stream(f"{out_path}.{own}", compression=None) as out, out_fs.open_output_stream(f"{out_path}.idx.{own}", compression=None) as index:
        for headers, head, block in split_records(inflated(raw)):
            data = member(head + block + END)
            out.write(data)
            index.write("\t".join((str(offset), str(len(data)), headers.get("warc-type", ""), headers.get("warc-record-id", ""), headers.get("warc-payload-digest", ""))).encode() + b"\n")
            offset, n = offset + len(data), n + 1
    out_fs.move(f"{out_path}.{own}", out_path)
    out_fs.move(f"{out_path}.idx.{own}", f"{out_path}.idx")
    return n, offset


def normalise(spark: SparkSession, folder: str, out_folder: str) -> DataFrame:
    """(archive, records, bytes) of the archives that it writes to out_folder: one for each *.gz file of folder, with its index beside it.

    The files of folder are listed by Spark and dealt out, one to a task at a time; both folders must be shared by all machines.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    n = max(1, files.count())
    fs, path = _filesystem(out_folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                target = f"{out_folder.rstrip('/')}/{os.path.basename(p).removesuffix('.gz').removesuffix('.txt')}.warc.gz"
                records_, size = normalise_file(p, target)
                yield pa.RecordBatch.from_pydict({"archive": [target], "records": [records_], "bytes": [size]})

    return cut(files.repartition(n).mapInArrow(run, "archive string, records long, bytes long"))


def read_archives(archives: DataFrame, members_per_part: int = 512, verify: bool = True) -> DataFrame:
    """(archive, offset, type, record_id, uri, refers_to, digest, payload_length, payload) of each record of the archives.

    The index says where members begin, so an archive is read in parts by several tasks, each from an offset. payload is
    null for revisits. verify: a payload that its digest doesn't fit raises. Records that repeat are read each; an archive
    without records, or an empty table, gives no rows.
    """

    def parts(batches):
        for b in batches:
            for a in b.column(0).to_pylist():
                fs, path = _filesystem(a)
                spans: list[list[int]] = []  # the borders of the members of each part
                with fs.open_input_stream(f"{path}.idx", compression=None) as f:
                    for line in io.BufferedReader(f):
                        offset, length = map(int, line.split(b"\t")[:2])
                        if not spans or len(spans[-1]) > members_per_part or offset - spans[-1][0] > 8 * BLOCK:
                            spans.append([offset])
                        spans[-1].append(offset + length)
                if spans:
                    yield pa.RecordBatch.from_arrays([pa.array([a] * len(spans)), pa.array(spans, pa.list_(pa.int64()))], ["archive", "borders"])

    def run(batches):
        import hashlib

        names = ["archive", "offset", "type", "record_id", "uri", "refers_to", "digest", "payload_length", "payload"]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        for b in batches:
            for a, borders in zip(*(b.column(k).to_pylist() for k in range(2))):
                fs, path = _filesystem(a)
                with fs.open_input_file(path) as f:
                    f.seek(borders[0])
                    raw = memoryview(f.read(borders[-1] - borders[0]))
                out, size = [], 0
                for offset, end in zip(borders, borders[1:]):
                    data = zlib.decompress(raw[offset - borders[0] : end - borders[0]], 31)
                    (headers, _, block), = split_records(iter([data]))
                    body = block.partition(END)[2] if headers["warc-type"] == "response" else None
                    digest = _hex(headers["warc-payload-digest"])
                    if verify and body is not None and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{a}: the payload at {offset} doesn't fit its digest")
                    out.append((a, offset, headers["warc-type"], headers["warc-record-id"], headers["warc-target-uri"], headers.get("warc-refers-to"), digest, int(headers.get("warc-payload-length", len(body or b""))), body))
                    size += len(body or b"")
                    if size > 8 * BLOCK or end == borders[-1]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0

    spark = archives.sparkSession
    spans = archives.select("archive").mapInArrow(parts, "archive string, borders array<long>")
    dealt = spans.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, "archive string, offset long, type string, record_id string, uri string, refers_to string, digest string, payload_length long, payload binary")


def _hex(digest: str) -> str:
    """The lower-case hex of a payload digest in hex or base 32."""
    value = digest.removeprefix("sha1:")
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Writes a record per page to monolithic gzip archives, normalises them, and gives the (archive, records, bytes) table of the result.

    Rows that repeat have a record each; an empty table gives archives without records, or none.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_monolithic(records(decided(pages, id_col, body_col, least), id_col, url_col, body_col), f"{folder}/monolithic")
    return normalise(spark, f"{folder}/monolithic", f"{folder}/archives")
