"""WARC archives with a two-level capture index.

write_archives() writes gzip-member-per-record WARC/1.1 files into the shared folder, a revisit record for
each page whose payload another page answers for. write_index() sorts the captures by reversed-host URL
key into compressed blocks of BLOCK_LINES lines; each index file ends with its sparse block directory
(first key, offset, length of every block). search() finds a key's files among the files' first and last keys (one file a
partition), binary-searches these files' directories, and deals the blocks it has found to tasks that read them and then
the records by range. A key with many captures is many blocks, so many tasks share it.

Equal payloads: the page with the largest page_id is the response. Payloads move only if the table of shared digests is too large for Spark to
broadcast, by a join that it can split. Every record has an id of its own (a UUID), also where rows share a page_id.

Edge cases: a null html is an empty payload; a null url is
an empty URL; control characters and blanks in URLs are percent-encoded, URLs may be of any length; equal largest page_ids are all responses; a null
page_id beside a non-null one is a revisit, and where all are null, all are responses. An empty table
gives no files and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import fresh_dir, open_fs, written

MIN_PAYLOAD = 0
BLOCK_LINES = 256
#: Fixed values of the WARC/1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CAPTURE = "key string, page_id long, record_type string, folder string, file string, offset long, length long"
READ = "key string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def url_key(url: str) -> str:
    """Scheme dropped, host lower-cased and reversed: com,example)/path?query."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url
    port = "" if m[2] in (None, ":80", ":443") else m[2]
    return ",".join(reversed(m[1].lower().split("."))) + port + ")" + (m[3] or "/")


def number(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def page_of(value: str) -> int | None:
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """The page numbers are extension fields, which readers of WARC pass over."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"Page-ID: {number(page_id)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Date: {DATE}", f"Page-Refers-To: {number(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> dict:
    """A record's fields; of a revisit, the length and digest of the payload that it stands for."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload differs from its digest")
    return {"record_id": fields["WARC-Record-ID"], "page_id": page_of(fields["Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": n, "payload_digest": digest, "refers_to": page_of(fields["Page-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def write_archives(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes all pages; gives the captures (a written table), a row for each record."""
    spark, folder = pages.sparkSession, fresh_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    shared = keyed.filter(F.col("n") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("answer"), F.max_by("url", "page_id").alias("answer_url"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    shared = written(shared, "answers")  # of known size
    # without an answer, or for the answer itself: a response
    typed = keyed.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", "answer", "answer_url", (F.col("answer").isNotNull() & (F.col("n") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("answer"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name, file = f"{uuid.uuid4().hex}.warc.gz", None  # a task that runs again writes another file; only the captures of one are kept
        for batch in batches:
            out = []
            for page, url, payload, digest, answer, answer_url, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    file = fs.open_output_stream(f"{top}/{name}", compression=None)
                    file.write(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode())))
                url, at = clean_url(url), file.tell()
                file.write(member(record(page, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), answer, clean_url(answer_url), revisit)))
                out.append((url_key(url), page, "revisit" if revisit else "response", folder, name, at, file.tell() - at))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "record_type", "folder", "file", "offset", "length"])
        if file is not None:
            file.close()

    return written(typed.mapInArrow(run, CAPTURE), "captures")


def write_index(captures: DataFrame) -> DataFrame:
    """The two-level index of the captures; gives its top level (a written table): first and last key, folder and file of each index file."""
    spark, folder = captures.sparkSession, fresh_dir(captures.sparkSession, "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name, file, lines, directory = f"{uuid.uuid4().hex}.idx", None, [], []

        def flush() -> None:
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            directory.append((lines[0][0], file.tell(), len(packed)))
            file.write(packed)
            lines.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    file = fs.open_output_stream(f"{top}/{name}", compression=None)
                lines.append(line)
                last = line[0]
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if file is not None:
            at = file.tell()
            file.write(zlib.compress(json.dumps(directory).encode()))
            file.write(struct.pack("<Q", at))
            file.close()
            yield pa.record_batch({"key": pa.array([directory[0][0]]), "last": pa.array([last]), "folder": pa.array([folder]), "file": pa.array([name])})

    # a key with many captures goes on over several files
    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return written(ordered.mapInArrow(run, "key string, last string, folder string, file string"), "files")


def block_at(file, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(file.read_at(length, offset)).decode().split("\n")]


def directory_of(folder: str, name: str) -> tuple[list[str], list[list]]:
    """The first keys and the entries of the sparse directory at an index file's end."""
    fs, top = open_fs(folder)
    with fs.open_input_file(f"{top}/{name}") as file:
        size = file.size()
        start = struct.unpack("<Q", file.read_at(8, size - 8))[0]
        blocks = json.loads(zlib.decompress(file.read_at(size - 8 - start, start)))
    return [b[0] for b in blocks], blocks


def records_of(lines: list[list]) -> Iterator[dict]:
    """Reads the captures' records by range, file by file in the order of their offsets."""
    opened: dict[tuple[str, str], object] = {}
    try:
        for key, _, _, folder, name, offset, length in sorted(lines, key=lambda x: (x[3], x[4], x[5])):
            if (folder, name) not in opened:
                for file in opened.values():
                    file.close()
                opened.clear()
                fs, top = open_fs(folder)
                opened[folder, name] = fs.open_input_file(f"{top}/{name}")
            yield {"key": key} | parse(zlib.decompress(opened[folder, name].read_at(length, offset), 31))
    finally:
        for file in opened.values():
            file.close()


def as_batch(found: list[dict]) -> pa.RecordBatch:
    kinds = {"key": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.record_batch({k: pa.array([x[k] for x in found], t) for k, t in kinds.items()})


def search(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The records of all captures of the column key of `keys` (each key once). files: what write_index() gives."""
    # the top level: a first and a last key a file, so as many as the index has partitions
    top_level = sorted((r.key, r.last, r.folder, r.file) for r in files.collect())
    firsts, lasts = [x[0] for x in top_level], [x[1] for x in top_level]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that can hold a key of the sorted ones, with these keys, BLOCK_LINES at most."""
        directories: dict[int, tuple[list[str], list[list]]] = {}
        open_: dict[tuple[int, int], tuple[tuple, list[str]]] = {}
        done: list[tuple] = []

        def close(place: tuple[int, int]) -> None:
            entry, wanted = open_.pop(place)
            done.append((*entry, wanted))

        def batch_of() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["folder", "file", "offset", "length", "keys"])
            done.clear()
            return out

        for batch in batches:
            for key in batch.column(0).to_pylist():
                # keys come in order: files and blocks before this key's are done with
                directories = {f: directories.get(f) or directory_of(*top_level[f][2:]) for f in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))}
                places = {(f, b): (*top_level[f][2:], *entries[b][1:]) for f, (starts, entries) in directories.items() for b in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key))}
                for place in [p for p in open_ if p not in places]:
                    close(place)
                for place, entry in places.items():
                    open_.setdefault(place, (entry, []))[1].append(key)
                    if len(open_[place][1]) == BLOCK_LINES:
                        close(place)
                if len(done) >= 1000:
                    yield batch_of()
        for place in list(open_):
            close(place)
        if done:
            yield batch_of()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, offset, length, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                fs, top = open_fs(folder)
                with fs.open_input_file(f"{top}/{name}") as file:
                    found = set(wanted)
                    lines = [x for x in block_at(file, offset, length) if x[0] in found]
                if lines:
                    yield as_batch(list(records_of(lines)))

    parts = max(12, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    found = ordered.mapInArrow(blocks, "folder string, file string, offset long, length long, keys array<string>")
    return found.repartition(parts).mapInArrow(read, READ)


def with_keys(urls: DataFrame) -> DataFrame:
    """_searched, key of the column url; a null URL is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([url_key(clean_url(u)) for u in batch.column(0).to_pylist()], pa.string())], names=["_searched", "key"])

    return urls.select("url").mapInArrow(run, "_searched string, key string")


def lookup(files: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of all captures of the column url of `urls`, with the searched URL as _searched. A URL without a capture gives no row."""
    searched = with_keys(urls)
    return search(files, searched).join(searched, "key")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return search(write_index(write_archives(pages)), with_keys(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS answer,
  list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', hex[i]) - 1), 4, '0')), lambda x, y: concat(x, y)) AS bits FROM h)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INTEGER) * (16 >> j)))::BIGINT + 1, 1)), lambda x, y: concat(x, y)) AS payload_digest,
  CASE WHEN page_id = answer THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = answer THEN NULL ELSE answer END AS refers_to
FROM b
"""
