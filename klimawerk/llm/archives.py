"""Legacy ARC archives, and their conversion to WARC.

An ARC file starts with a version block and holds records of one header line each: version 1 has the fields URL, IP address,
date, content type and length, version 2 also result code, checksum, location, offset and file name before the length. The
last field gives the bytes that follow. The converter reads the version from the block, parses header lines by it, takes
exactly the declared bytes, and makes the WARC record: type, record id (from archive, place and URL, so reruns agree), date,
payload digest and block.

Of records with equal payloads the one of smallest page id becomes a response, the others revisits that refer to it. Digests
are grouped over all archives first; what a record needs to know about its response is joined to it by archive and place.

The version block becomes the ``warcinfo`` record that the others name. Every record is a gzip member of its own, so readers can
go to any of them. Payloads may be any bytes.

An archive never becomes a row: a task writes one for its rows, under a passing name that is replaced when it is whole, so a
repeated task leaves no half archive; ``spark.sql.files.maxPartitionBytes`` bounds their size. Spark deals paths, and tasks read
the archives as streams, record by record. The folder must be one that both Spark and pyarrow can open (a shared mount, HDFS, S3,
GCS, Azure).

Defined results: a null html is an empty payload, a null url is ``about:blank``, blanks in urls are escaped. A row without id
comes last among equal payloads; rows of one id and one payload are all responses if the id is the smallest. Pages with equal
rows get a record each. An empty table gives empty archives and an empty result. Other columns are ignored, whatever their
names. Converted archives keep the names of theirs, which are unique within a folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from klimawerk.llm.storage import written
from klimawerk.session import fresh_folder

NO_ID = (1 << 63) - 1

# Header fields of ARC records by version, and the prefix of the version block's URL.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename",
        "Archive-length",
    ],
}
FILEDESC = "filedesc://"
CRAWLED = "20240101000000"
ADDRESS = "192.0.2.1"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# --- ARC -------------------------------------------------------------------------------------------------------------

def arc_block(name: str, version: str) -> bytes:
    """Version block: header line, version line, and the names of the header fields."""
    body = f"{version} 0 generator\n{' '.join(ARC_FIELDS[version])}\n".encode("ascii")
    return _arc_record(f"{FILEDESC}{name}", "0.0.0.0", "text/plain", body, version, name)


def _arc_record(url: str, address: str, kind: str, body: bytes, version: str, name: str) -> bytes:
    middle = f" 200 - - 0 {name}" if version == "2" else ""
    return f"{url} {address} {CRAWLED} {kind}{middle} {len(body)}\n".encode("utf-8") + body + b"\n"


def arc_record(page_id: int | None, url: str | None, html: str | None, version: str, name: str) -> bytes:
    """A page as the HTTP response that a crawler would have stored."""
    payload = (html or "").encode("utf-8")
    mark = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n"
    address = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank")
    return _arc_record(address, ADDRESS, "text/html", head.encode("ascii") + payload, version, name)


def arc_head(stream: BinaryIO) -> tuple[str, str, bytes]:
    """Version, date and bytes of the version block that an ARC file starts with."""
    parts, body = _arc_entry(stream) or ([""], b"")
    if not parts[0].startswith(FILEDESC):
        raise ValueError("an ARC file starts with its version block")
    version = body.split(b" ", 1)[0].decode("ascii")
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    return version, parts[2], body


def arc_bodies(stream: BinaryIO, version: str) -> Iterator[tuple[int, dict, bytes]]:
    """(number, header fields, body) of each record after the version block."""
    fields, number = ARC_FIELDS[version], 0
    while entry := _arc_entry(stream):
        parts, body = entry
        if len(parts) != len(fields):
            raise ValueError(f"a version {version} header line has {len(fields)} fields, not {len(parts)}")
        yield number, dict(zip(fields, parts)), body
        number += 1


def read_arc(stream: BinaryIO) -> Iterator[tuple[int, dict, bytes]]:
    """(number, header fields, body) of each record of an ARC file."""
    version, _, _ = arc_head(stream)
    yield from arc_bodies(stream, version)


def _arc_entry(stream: BinaryIO) -> tuple[list[str], bytes] | None:
    while line := stream.readline():
        if line.strip():
            parts = line.decode("utf-8").rstrip("\r\n").split(" ")
            return parts, _exactly(stream, int(parts[-1]))
    return None


def _exactly(stream: BinaryIO, length: int) -> bytes:
    body = stream.read(length)
    if len(body) != length:
        raise ValueError(f"{length} bytes declared, {len(body)} found")
    return body


# --- WARC ------------------------------------------------------------------------------------------------------------

def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block with its blank line, and the payload; all is payload without such a block."""
    at = body.find(b"\r\n\r\n")
    return (body[:at + 4], body[at + 4:]) if body.startswith(b"HTTP/") and at >= 0 else (b"", body)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode("ascii"):
            return value.strip().decode("utf-8")
    return None


def record_id(archive: str, number: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number} {url}')}>"


def _warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def info_id(archive: str) -> str:
    return record_id(archive, -1, FILEDESC)


def warc_info(archive: str, name: str, version: str, date: str, version_block: bytes) -> bytes:
    """The ``warcinfo`` record of a converted archive, with the lines of its version block as a folded field."""
    lines = b"".join(b" " + line + b"\r\n" for line in version_block.splitlines())
    block = (
        f"format: WARC File Format 1.0\r\nconverted-from: {archive}\r\narc-version: {version}\r\narc-version-block:\r\n".encode("utf-8") + lines
    )
    head = [
        "WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {info_id(archive)}", f"WARC-Date: {_warc_date(date)}",
        f"WARC-Filename: {name}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


def warc_record(archive: str, number: int, fields: dict, body: bytes, response: tuple[str, str, int | None] | None) -> bytes:
    """The WARC record of an ARC record; ``response`` is (record id, URL, page id) of the record that it revisits."""
    head, payload = split_http(body)
    block = head if response else body
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if response else 'response'}",
        f"WARC-Record-ID: {record_id(archive, number, fields['URL'])}",
        f"WARC-Date: {_warc_date(fields['Archive-date'])}",
        f"WARC-Warcinfo-ID: {info_id(archive)}",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"Content-Type: {'application/http; msgtype=response' if head else fields['Content-type']}",
    ]
    if response:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
            f"WARC-Refers-To: {response[0]}",
            f"WARC-Refers-To-Target-URI: {response[1]}",
        ]
        if response[2] is not None:
            lines.append(f"X-Refers-To-Page-Id: {response[2]}")
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict, bytes]]:
    """(header fields in lower case, block) of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, _exactly(stream, int(fields["content-length"]))


# --- Spark -----------------------------------------------------------------------------------------------------------

PAGES = 1 << 12
"""Rows of a record batch that a task hands on."""
MOST_TASKS = 20_000
"""Tasks that convert archives; beyond it a task takes several, one after another."""


def _place(uri: str):
    """File system and path in it of a path as Spark writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


@contextmanager
def _unpacked(uri: str):
    system, path = _place(uri)
    with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as packed, gzip.GzipFile(fileobj=packed) as stream:
        yield stream


def _store(folder: str, name: str, records: Iterable[bytes]) -> int:
    """Write records as gzip members of one archive, which gets its name when it is whole; their number."""
    from pyarrow import fs

    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    passing, n = f"{path}/{name}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(passing, compression=None, buffer_size=1 << 20) as out:
        for record in records:
            out.write(gzip.compress(record, compresslevel=1, mtime=0))
            n += 1
    # An earlier attempt of the task may have left the archive.
    if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        system.delete_file(f"{path}/{name}")
    system.move(passing, f"{path}/{name}")
    return n


def _batches(rows: Iterable[tuple], fields: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == PAGES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], fields)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], fields)


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write pages as ARC archives, versions 1 and 2 in turn; their folder."""
    from pyspark import TaskContext

    folder = fresh_folder(pages.sparkSession, "llm-arc")

    def build(batches):
        number = TaskContext.get().partitionId()
        version, name = str(number % 2 + 1), f"pages-{number:05d}.arc.gz"
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(3))))
        first = next(rows, None)
        if first is not None:
            def records():
                yield arc_block(name, version)
                yield arc_record(*first, version, name)
                for row in rows:
                    yield arc_record(*row, version, name)

            n = _store(folder, name, records())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])

    source = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    source.mapInArrow(build, "archive string, records bigint").write.format("noop").mode("overwrite").save()
    return folder


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path) of the archives of a folder, dealt to tasks by their sizes; their bytes are not read here."""
    system, at = _place(path)
    system.create_dir(at, recursive=True)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "path")


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """(archive, number, page_id, url, digest) of each ARC record."""
    fields = ["archive", "number", "page_id", "url", "digest"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]

    def rows(batches):
        for batch in batches:
            for archive, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _unpacked(at) as stream:
                    for number, header, body in read_arc(stream):
                        head, payload = split_http(body)
                        page_id = http_field(head, "X-Page-Id")
                        yield archive, number, None if page_id is None else int(page_id), header["URL"], payload_digest(payload)

    return _archives(spark, path).mapInArrow(
        lambda batches: _batches(rows(batches), fields, types), "archive string, number int, page_id bigint, url string, digest string"
    )


def convert(spark: SparkSession, arc_path: str) -> str:
    """Convert all ARC archives of a folder to WARC archives; their folder."""
    found = written(arc_records(spark, arc_path), "arc-records")
    rank = F.coalesce("page_id", F.lit(NO_ID))
    # Written, as the responses below, so that both sides of each join are shuffled for it and Spark may split the partition
    # of a very common payload.
    least = written(
        found.groupBy("digest").agg(F.min(rank).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "common-payloads"
    )
    several = found.join(least, "digest").withColumn("rank", rank)
    # The response is the record of smallest id; its id and URL are looked up among records of that rank only.
    place = F.min(F.struct("archive", "number", "url", "page_id")).alias("r")
    responses = written(
        several.where("rank = least and page_id is not null").groupBy("digest").agg(place).unionByName(
            several.where(f"least = {NO_ID}").groupBy("digest").agg(place)
        ),
        "responses",
    )
    revisits = several.where(f"rank != least or (least = {NO_ID})").join(responses, "digest").where(
        "not (archive = r.archive and number = r.number)"
    )
    # As many per archive as it has records.
    per_archive = revisits.groupBy("archive").agg(
        F.collect_list(F.struct("number", F.col("r.archive").alias("to"), F.col("r.number").alias("to_number"), F.col("r.url").alias("url"), F.col("r.page_id").alias("page_id"))).alias("revisits")
    )

    folder = fresh_folder(spark, "llm-warc")

    def build(batches):
        for batch in batches:
            for archive, at, listed in zip(*(batch.column(c) for c in range(3))):
                archive, to = archive.as_py(), {r["number"]: r for r in listed.as_py() or []}
                name = f"{archive.removesuffix('.gz').removesuffix('.arc')}.warc.gz"

                def records(stream):
                    version, date, version_block = arc_head(stream)
                    yield warc_info(archive, name, version, date, version_block)
                    for number, header, body in arc_bodies(stream, version):
                        r = to.get(number)
                        response = (record_id(r["to"], r["to_number"], r["url"]), r["url"], r["page_id"]) if r else None
                        yield warc_record(archive, number, header, body, response)

                with _unpacked(at.as_py()) as stream:
                    n = _store(folder, name, records(stream))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])

    # Only paths and lists of revisits move. They are small, so the number of tasks is stated: one archive each.
    paths = _archives(spark, arc_path)
    tasks = min(max(paths.count(), 1), MOST_TASKS)
    joined = paths.join(per_archive.hint("shuffle_hash"), "archive", "left").select("archive", "path", "revisits").repartition(tasks)
    joined.mapInArrow(build, "archive string, records bigint").write.format("noop").mode("overwrite").save()
    return folder


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each WARC record of a page."""
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def rows(batches):
        for batch in batches:
            for at in batch.column(1).to_pylist():
                with _unpacked(at) as stream:
                    for header, block in read_warc(stream):
                        if header["warc-type"] == "warcinfo":
                            continue
                        head, payload = split_http(block)
                        page_id, refers_to = http_field(head, "X-Page-Id"), header.get("x-refers-to-page-id")
                        revisit = header["warc-type"] == "revisit"
                        # A revisit keeps the response's HTTP header, which gives the length of the payload left out.
                        size = int(http_field(head, "Content-Length") or 0) if revisit else len(payload)
                        digest = header["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and digest != payload_digest(payload):
                            raise ValueError(f"payload of {header['warc-record-id']} does not match its digest")
                        yield (
                            None if page_id is None else int(page_id), size, digest, header["warc-type"],
                            None if refers_to is None else int(refers_to),
                        )

    return _archives(spark, path).mapInArrow(
        lambda batches: _batches(rows(batches), fields, types),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    )


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as ARC, convert the archives to WARC and read these back: a row per page."""
    spark = pages.sparkSession
    return warc_records(spark, convert(spark, write_arc(pages, id_col, url_col, html_col)))
