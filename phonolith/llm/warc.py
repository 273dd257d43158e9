"""Operator 9: dictionary-compressed WARC archives.

Each page becomes one WARC/1.1 record. Pages with equal payloads of at least
``min_bytes`` bytes are stored once: the one with the largest id is a response,
the others are revisits that refer to it. Tasks write archives of bounded size;
each begins with a skippable frame (0x184D2A5D) that holds a Zstandard
dictionary built from the archive's own records, and every record is a frame
of its own, so records can be read one by one. Where the records are too few to
learn from, their pieces are learnt from, and where even these are, the
beginning of the first record is the dictionary as it is; none goes without.

Archives are written through pyarrow's file systems below the cluster's shared
folder; names are unique, and the manifest, which Spark commits, lists those
of successful tasks, so a retried task leaves at most a file nobody reads.
Reading opens the manifest's archives by name inside the tasks; their contents
are never shuffled. Page ids must be whole numbers (they are written as such
and read back as long).

Defined results: a null html is an empty payload; a null url or one with white
space or control characters is written percent-encoded or as a urn; a null
page id becomes the word ``null`` in the record id and is only a response if
all its equals have null ids; rows that share the largest id are all
responses; a very long payload is a record (and beyond ``archive_bytes`` an
archive) by itself; an empty table writes no archive; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import new_folder, staged, table

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
#: Bits of a payload's hash by which it is looked up before the shuffle.
SHORT_BITS = 20
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records in an archive (one larger record is an archive by itself).
ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES = 64_000
LEVEL = 3
#: Bytes of the pieces that few records are cut into, and of a record that is the dictionary itself.
PIECE_BYTES = 64
PLAIN_BYTES = 1_000
#: Archives that a task reads, about.
TASK_ARCHIVES = 64
#: Names that Hadoop has for stores which pyarrow calls otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

_unsafe = re.compile(r"[\x00-\x20\x7f%]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    found = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "null" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, when: str) -> bytes:
    """One WARC record; refers_to makes it a revisit."""
    target = "urn:page:unknown" if url is None else _unsafe.sub(lambda m: f"%{ord(m[0]):02X}", url) or "urn:page:empty"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Target-URI", target),
        ("WARC-Date", when),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([] if refers_to is None else [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes], level: int = LEVEL) -> bytes:
    """A dictionary for the records: learnt from them, else from their pieces, else the beginning of the first."""
    few = b"".join(records)[: 16 * DICTIONARY_BYTES]
    pieces = [few[at : at + PIECE_BYTES] for at in range(0, len(few), PIECE_BYTES)]
    for samples, size in ((records, DICTIONARY_BYTES), (pieces, min(DICTIONARY_BYTES, max(256, len(few) // 4)))):
        try:
            return zstandard.train_dictionary(size, samples, k=200 if samples is records else 50, d=8, steps=1, level=level).as_bytes()
        except zstandard.ZstdError:  # too few, too short or too alike to learn from
            continue
    return few[:PLAIN_BYTES]


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """Skippable frame with the dictionary, then one frame for each record."""
    words = dictionary(records, level)
    compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True, write_checksum=True).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(words)), words, *map(compress, records)])


def opened(uri: str):
    """(pyarrow file system, path) of a folder's address."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    except pa.ArrowInvalid as error:
        raise ValueError(f"archives cannot be written to {uri}: pyarrow has no file system for {scheme}://") from error


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends."""
    info = zstandard.get_frame_parameters(data[at : at + 18])
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * bool(info.has_checksum)


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    view = memoryview(data)
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompress
    at = 8 + size
    while at < len(data):
        if bytes(view[at : at + 4]) != ZSTD_MAGIC:
            raise ValueError(f"no record at {at}")
        end = frame_end(view, at)
        yield decompress(view[at:end])
        at = end


def parsed(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """(WARC fields, payload bytes, payload or None for a revisit); a wrong digest or length is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "revisit":
        return fields, size, None
    if len(payload) != size or fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is damaged")
    return fields, size, payload


# --- the operator -----------------------------------------------------------------


def with_originals(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, payload, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    light = rows.select("id", "sha", F.length("payload").alias("size")).where(F.col("size") >= min_bytes)
    groups = light.groupBy("sha").agg(F.max("id").alias("most"), F.min("id").alias("least"), F.count("*").alias("n"), F.count("id").alias("named"))
    groups = groups.where((F.col("n") > 1) & ((F.col("most") != F.col("least")) | (F.col("named") < F.col("n"))) & F.col("most").isNotNull()).select("sha", "most")
    # Written out, so that the join shuffles both sides and Spark can split a payload that very many pages share.
    groups = staged(groups, "originals")
    # Only payloads whose hash agrees with a repeated one's in its low bits are shuffled, at most 2**20 numbers are sent for that.
    short = F.xxhash64("sha").bitwiseAND(F.lit((1 << SHORT_BITS) - 1)).cast("int")
    repeated = F.broadcast(groups.select(short.alias("short"), F.lit(True).alias("may")).distinct())
    marked = rows.withColumn("short", short).join(repeated, "short", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("most")), F.col("most")).alias("refers_to")
    joined = marked.where("may").join(groups, "sha", "left").select("id", "url", "payload", refers)
    return marked.where("may IS NULL").select("id", "url", "payload", F.lit(None).cast(joined.schema["refers_to"].dataType).alias("refers_to")).unionByName(joined)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, when: str | None = None) -> DataFrame:
    """Write (id, url, payload, refers_to) below folder; the manifest (name, records, bytes), stored there too."""
    when = when or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    archives = f"{folder}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(archives)
        store.create_dir(base, recursive=True)

        def written(records: list[bytes]) -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                one = record(*(batch.column(k)[i].as_py() for k in range(4)), when)
                if held and size + len(one) > archive_bytes:
                    yield written(held)
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield written(held)

    manifest = f"{folder}/manifest"
    rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "name string, records long, bytes long").write.parquet(manifest)
    return rows.sparkSession.read.schema("name string, records long, bytes long").parquet(manifest)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the manifest's archives below folder."""
    archives = f"{folder}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(archives)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    data = source.read()
                found = []
                for raw in records_of(data):
                    fields, size, _ = parsed(raw)
                    refers = fields.get("WARC-Refers-To")
                    found.append((page_of(fields["WARC-Record-ID"]), size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], refers and page_of(refers)))
                ids, sizes, digests, kinds, refs = map(list, zip(*found)) if found else ([], [], [], [], [])
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "payload_bytes": pa.array(sizes, pa.int64()), "payload_digest": pa.array(digests, pa.string()), "record_type": pa.array(kinds, pa.string()), "refers_to": pa.array(refs, pa.int64())})

    # Only names are dealt out.
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.count() // TASK_ARCHIVES + 1)
    return manifest.select("name").repartition(tasks, "name").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages' archives and read them back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(with_originals(pages, min_bytes, id_col, url_col, html_col), folder), folder)


def op9_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_warc_dictionary": op9_warc_dictionary}

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE = {
    "op9_warc_dictionary": f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('{_ALPHABET}', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS most
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> most THEN most END AS refers_to FROM b
"""
}
