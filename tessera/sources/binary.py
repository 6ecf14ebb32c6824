"""Readers of binary and structured files: key-value record logs, session event files, TOML lock files, file types by content.

Frames of files have the columns path and content, as spark.read.format("binaryFile") gives them. A log is one
ordered stream, so a file is one task's work.
"""

from __future__ import annotations

import hashlib
import struct
import tomllib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The record format (big-endian magic, version, operation, key and value lengths, expiry; then key, value, CRC-32) and its limits.
RECORD, RECORD_MAGIC, RECORD_VERSION = struct.Struct(">IBBIIq"), 0x4D4B5631, 1
OPERATIONS = {1: "SET", 2: "DELETE"}
MOST_KEY, MOST_VALUE = 1 << 20, 1 << 28

#: Leading bytes (hexadecimal) of file types, in the order in which they are tried.
SIGNATURES = [
    ("jpeg", ["FFD8FF"]),
    ("png", ["89504E470D0A1A0A"]),
    ("gif", ["474946383761", "474946383961"]),
    ("pdf", ["255044462D"]),
    ("zip", ["504B0304", "504B0506", "504B0708"]),
    ("gzip", ["1F8B"]),
    ("bzip2", ["425A68"]),
    ("xz", ["FD377A585A00"]),
    ("tar", []),
    ("rar", ["526172211A07"]),
    ("7z", ["377ABCAF271C"]),
    ("pe-executable", ["4D5A"]),
    ("elf-executable", ["7F454C46"]),
    ("mach-o-executable", ["FEEDFACE", "FEEDFACF", "CAFEBABE"]),
    ("sqlite", ["53514C69746520666F726D6174203300"]),
]


def parsed(files: DataFrame, parse: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """path and what parse() gives for each file's content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [{"path": path} | r for r in parse(content.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    full = f"path string, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(full))
    return files.select("path", "content").mapInArrow(run, full)


def records(content: bytes) -> Iterator[dict]:
    """Whole and undamaged records from the start; what follows the first other one is dropped."""
    at, seq = 0, 0
    while at + RECORD.size <= len(content):
        magic, version, op, key, value, expires = RECORD.unpack_from(content, at)
        end = at + RECORD.size + key + value
        if magic != RECORD_MAGIC or version != RECORD_VERSION or op not in OPERATIONS or key > MOST_KEY or value > MOST_VALUE or end + 4 > len(content):
            return
        if zlib.crc32(content[at:end]) != struct.unpack_from(">I", content, end)[0]:
            return
        yield {"offset": at, "seq": seq, "op": OPERATIONS[op], "key": content[at + RECORD.size : end - value], "value": content[end - value : end], "expires_at": expires}
        at, seq = end + 4, seq + 1


def record_log(files: DataFrame) -> DataFrame:
    return parsed(files, records, "offset long, seq long, op string, key binary, value binary, expires_at long")


def record(op: str, key: bytes, value: bytes = b"", expires_at: int = 0) -> bytes:
    """One record as bytes."""
    body = RECORD.pack(RECORD_MAGIC, RECORD_VERSION, {v: k for k, v in OPERATIONS.items()}[op], len(key), len(value), expires_at) + key + value
    return body + struct.pack(">I", zlib.crc32(body))


class Fields:
    """Big-endian fields one after the other; reading beyond the end raises EOFError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(f">{kind}", self.raw(struct.calcsize(f">{kind}")))[0]

    def text(self) -> str:
        return self.raw(self.number("H")).decode(errors="replace")

    def block(self) -> bytes:
        return self.raw(self.number("I"))


def events(content: bytes) -> Iterator[dict]:
    """Session events. A torn tail is tolerated once an event was read; else it raises."""
    outer, idx = Fields(content), 0
    while outer.at < len(content):
        try:
            e = Fields(outer.block())
            row = {"idx": idx, "offset_ns": e.number("q"), "type": e.number("B"), "method": e.text(), "event_path": e.text(), "status": e.number("i")}
            headers, inner = {}, Fields(e.block())
            while inner.at < len(inner.data):
                try:
                    name, value = inner.text(), inner.text()
                except EOFError:
                    break
                headers.setdefault(name, []).append(value)
            body = e.block()
            yield row | {"headers": list(headers.items()), "body": body, "intact": e.raw(32) == hashlib.sha256(body).digest()}
        except EOFError:
            if not idx:
                raise ValueError("damaged session file") from None
            return
        idx += 1


def session_events(files: DataFrame) -> DataFrame:
    return parsed(files, events, "idx int, offset_ns long, type int, method string, event_path string, status int, headers map<string, array<string>>, body binary, intact boolean")


def event(offset_ns: int, type_: int, method: str, path: str, status: int, headers: dict[str, list[str]], body: bytes) -> bytes:
    """One session event as bytes."""
    text = lambda s: struct.pack(">H", len(s.encode())) + s.encode()
    block = lambda b: struct.pack(">I", len(b)) + b
    head = b"".join(text(k) + text(v) for k, values in headers.items() for v in values)
    return block(struct.pack(">qB", offset_ns, type_) + text(method) + text(path) + struct.pack(">i", status) + block(head) + block(body) + hashlib.sha256(body).digest())


def _lock(content: bytes) -> Iterator[dict]:
    doc = tomllib.loads(content.decode())
    if "package" not in doc:
        raise ValueError("no [[package]] sections")
    for p in doc["package"]:
        if isinstance(p.get("name"), str):
            yield {"name": p["name"], "version": p.get("version", ""), "resolved": p.get("source"), "integrity": p.get("checksum"), "link": "source" not in p, "wants": [w for w in p.get("dependencies", []) if isinstance(w, str)]}


def toml_lock_packages(files: DataFrame) -> DataFrame:
    """path, name, version, resolved, integrity, link (a package without a source is the project's own), wants."""
    return parsed(files, _lock, "name string, version string, resolved string, integrity string, link boolean, wants array<string>")


def toml_lock_edges(packages: DataFrame) -> DataFrame:
    """path, src, dst as 'name version': a wanted 'name version' is that one, a bare name is the only package of that name."""
    label = F.concat_ws(" ", "name", "version")
    wanted = packages.select("path", label.alias("src"), F.explode("wants").alias("_w")).select("path", "src", F.split("_w", " ")[0].alias("name"), F.when(F.size(F.split("_w", " ")) > 1, F.split("_w", " ")[1]).alias("_v"))
    known = packages.select("path", "name", "version", label.alias("dst"))
    hits = wanted.join(known, ["path", "name"]).filter(F.col("_v").isNull() | (F.col("_v") == F.col("version")))
    only = hits.groupBy("path", "src", "name", "_v").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    return only.filter("_v IS NOT NULL OR n = 1").select("path", "src", "dst").distinct()


def file_type(content: Column, path: Column) -> Column:
    """The type by leading bytes, then by the extension, then text or binary by control bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    out = None
    for name, starts in SIGNATURES:
        if name == "tar":
            test = (F.octet_length(content) > 265) & (F.hex(F.substring(content, 258, 5)) == "7573746172")
        else:
            test = F.lit(False)
            for s in starts:
                test = test | head.startswith(s)
        out = F.when(test, name) if out is None else out.when(test, name)
    bare = F.regexp_replace(head, "^(?:EF|BB|BF|20|09|0D|0A)+", "")
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    low = F.lower(F.unhex(F.substring(bare, 1, 1024)).cast("string"))
    out = out.when(low.startswith("<?xml") | low.startswith("<svg"), F.when((suffix == ".svg") | low.contains("<svg"), "svg").otherwise("xml"))
    out = out.when(low.startswith("<!doctype html") | low.startswith("<html"), "html")
    out = out.when(suffix == ".json", "json").when(suffix.isin(".jsonl", ".ndjson"), "jsonl").when(suffix == ".csv", "csv")
    out = out.when(suffix.isin(".txt", ".md", ".markdown", ".log", ".ini", ".toml", ".yaml", ".yml", ".env"), "text")
    size = F.length(head) / 2
    controls = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), 1), lambda b: b.rlike("^(?:0[0-8EF]|1[0-9A-F])$")))
    return out.when(size == 0, "text").when(head.rlike("^(?:..)*?00"), "binary").when(controls / size < 0.02, "text").otherwise("binary")
