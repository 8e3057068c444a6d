"""WARC archives with Zstandard dictionaries: writer, reader and revisit records."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Magic number of the skippable frame that holds the dictionary.
DICT_FRAME = 0x184D2A5D
#: Bytes of records in an archive, of its dictionary, and of the records the dictionary is built from.
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES = 24 << 20, 24 << 10, 2 << 20
LEVEL = 4
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
BROADCAST_DIGESTS = 400_000
#: Groups of more equal payloads than this are broadcast also where the others meet by a shuffle.
HOT_ROWS = 10_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, digest, record_type, refers_to for each row of pages.

    Of rows with equal payloads of at least REVISIT_BYTES bytes the one with the largest id is the
    response, the others revisit it (refers_to, and refers_url, its url); rows that repeat its id are
    responses too. Shorter payloads are all responses. Null payloads are empty. An empty table gives no
    rows; other columns are ignored; ids are whole numbers or null.

    Payloads are compared by SHA-256; groups are combined from (digest, id) alone, so a hot payload costs
    one row for each task. Few groups are broadcast. Many meet their records by a shuffle, but for the
    groups of more than HOT_ROWS records (one for HOT_ROWS rows at most), which are broadcast all the same,
    and the short payloads, which have no group.
    """
    records = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("same", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.sha2("payload", 256)))
    groups = records.where(F.col("same").isNotNull()).groupBy("same").agg(F.max("id").alias("winner"), F.max_by("url", "id").alias("winner_url"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1 and winner is not null"))
    found = ["winner", "winner_url"]
    if groups.count() <= BROADCAST_DIGESTS:
        met = records.join(F.broadcast(groups.drop("n")), "same", "left")
    else:
        marked = records.join(F.broadcast(groups.where(F.col("n") > HOT_ROWS).drop("n")), "same", "left")
        open_ = F.col("same").isNotNull() & F.col("winner").isNull()
        met = marked.where(~open_).unionByName(marked.where(open_).drop(*found).join(groups.where(F.col("n") <= HOT_ROWS).drop("n"), "same", "left"))
    revisit = F.col("winner").isNotNull() & ~F.col("id").eqNullSafe(F.col("winner"))
    return met.select(
        "id",
        "url",
        "payload",
        F.sha1("payload").alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("winner")).alias("refers_to"),
        F.when(revisit, F.col("winner_url")).alias("refers_url"),
    )


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def _header_value(text: str) -> str:
    """Header values stay on one line: control characters, spaces and % in front of them are coded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _target(url) -> str:
    return _header_value(url) if url else "urn:x-no-url"


def record_bytes(record_id: str, page_id, url, payload: bytes, digest: str, record_type: str, refers_to, refers_url) -> bytes:
    """A record; a revisit names its response by target and date, as ids of pages may repeat."""
    block = _HTTP + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To-Target-URI: {_target(refers_url)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers_to}"] if record_type == "revisit" else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records at even distances; too few of them serve as the dictionary themselves."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICT_BYTES]


def write_archive(records: list[bytes]) -> bytes:
    """One archive: the dictionary in a skippable frame, then a frame for each record."""
    raw = _dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
    return b"".join([struct.pack("<II", DICT_FRAME, len(raw)), raw, *map(packer.compress, records)])


def read_archive(archive: bytes):
    """Header fields (names in lower case) and block of each record."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICT_FRAME:
        raise ValueError("the archive does not start with its dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    with io.BufferedReader(unpacker.stream_reader(memoryview(archive)[8 + size :], read_across_frames=True), 1 << 16) as f:
        while line := f.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError("no record where one should start")
            fields = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                fields[name.lower()] = value
            block = f.read(int(fields["content-length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield fields, block


def write_archives(records: DataFrame) -> DataFrame:
    """Archives (name, n_records, content) of plan_records() rows, each of about ARCHIVE_BYTES of records.

    Each task packs its own rows, so nothing is shuffled and memory is bounded by one archive. They are
    a table until export_archives() writes them as files; Spark's writer commits them, so a lost task
    leaves no half archive. Record ids derive from the task, the record's place in it and the page's id, and
    names from the digest of all records of an archive, so neither repeats. A record is held whole.
    """

    def run(batches):
        held, size, n, task = [], 0, 0, TaskContext.get().partitionId()

        def archive():
            content, digest = write_archive(held), hashlib.sha256()
            for x in held:
                digest.update(x)
            name = f"pages-{task:05d}-{digest.hexdigest()[:32]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([content], pa.binary())], ["name", "n_records", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for row in batch.slice(at, 128).to_pylist():
                    held.append(record_bytes(_urn("page", task, n, row["id"]), row["id"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"], row["refers_url"]))
                    n += 1
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        yield archive()
                        held, size = [], 0
        if held:
            yield archive()

    return records.mapInArrow(run, "name string, n_records bigint, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record: page_id, url, record_type, refers_to, payload (null in a revisit record),
    stated_digest and stated_bytes, which are those of the full payload. No archives give no rows; a record
    that is cut short fails the task."""

    def run(batches):
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in read_archive(content.as_py()):
                    number = lambda k, fields=fields: int(fields[k]) if k in fields else None
                    kind = fields["warc-type"]
                    payload = block[len(_HTTP) :] if kind == "response" else None
                    rows.append((number("x-page-id"), fields["warc-target-uri"], kind, number("x-refers-to-page-id"), payload, fields["warc-payload-digest"].removeprefix("sha1:"), number("x-payload-length")))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return archives.select("content").mapInArrow(
        run, "page_id bigint, url string, record_type string, refers_to bigint, payload binary, stated_digest string, stated_bytes bigint"
    )


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file into a folder (a path or a URI) that all executors share; each appears
    whole or not at all, and no archive replaces another."""

    def run(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for row in rows:
            part = f"{base}/.{row.name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(row.content)
            store.move(part, f"{base}/{row.name}")

    archives.select("name", "content").foreachPartition(run)


def op5_warc(spark, sf_dir):
    archives = materialize(write_archives(plan_records(table(spark, sf_dir, "pages"))))
    return read_archives(archives).select(
        "page_id",
        F.coalesce(F.octet_length("payload"), "stated_bytes").cast("long").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "stated_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP5_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
w as (select *, max(page_id) over (partition by html) as winner from p)
select page_id, payload_bytes, sha1(html) as payload_digest,
       case when payload_bytes >= 1000 and page_id is distinct from winner then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id is distinct from winner then winner end as refers_to
from w
"""
