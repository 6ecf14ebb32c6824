"""File transactions as data: conditions on an inventory, plans over a state that earlier statements leave, journals, program runs."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import crc32c

#: Which status may follow which.
TRANSITIONS = {
    "PLANNED": ["PREPARED", "ROLLING_BACK", "RECOVERY_REQUIRED"],
    "PREPARED": ["RUNNING", "ROLLING_BACK", "RECOVERY_REQUIRED"],
    "RUNNING": ["VERIFYING", "ROLLING_BACK", "RECOVERY_REQUIRED"],
    "VERIFYING": ["COMMITTING", "ROLLING_BACK", "RECOVERY_REQUIRED"],
    "COMMITTING": ["COMMITTED", "ROLLING_BACK", "RECOVERY_REQUIRED"],
    "ROLLING_BACK": ["ROLLED_BACK", "RECOVERY_FAILED"],
    "RECOVERY_REQUIRED": ["ROLLING_BACK", "RECOVERY_FAILED"],
    "RECOVERY_FAILED": ["ROLLING_BACK"],
}
TERMINAL = ["COMMITTED", "ROLLED_BACK"]
EFFECTS = ["create", "modify", "move", "delete", "overwrite", "noop"]
#: A journal's frame: magic, version, kind, sequence, payload length; then payload and CRC-32C of all but the magic.
FRAME, MAGIC, VERSION = struct.Struct(">4sHHQI"), b"UNDO", 1
PLAN = "txn string, position long, effect string, rollback_bytes long, error string"


def conditions(asked: DataFrame, inventory: DataFrame) -> DataFrame:
    """asked (kind, path, value, ...) with holds, over an inventory (path, type: file, dir or symlink, content). A link is neither file nor folder; contains and sha256 raise for what is no file."""
    known = inventory.select("path", F.col("type").alias("_t"), F.col("content").alias("_c"))
    rows = asked.join(known, "path", "left")
    needs_file = F.when(F.col("_t").eqNullSafe("file"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a condition needs a regular file: "), F.col("path"))).cast("boolean"))
    there = F.col("_t").isNotNull()
    holds = (
        F.when(F.col("kind") == "exists", there)
        .when(F.col("kind") == "not_exists", ~there)
        .when(F.col("kind") == "is_file", F.col("_t").eqNullSafe("file"))
        .when(F.col("kind") == "is_dir", F.col("_t").eqNullSafe("dir"))
        .when(F.col("kind") == "contains", needs_file & F.contains(F.col("_c"), F.col("value").cast("binary")))
        .when(F.col("kind") == "sha256", needs_file & (F.sha2("_c", 256) == F.lower("value")))
    )
    return rows.select(*asked.columns, holds.alias("holds"))


def planned(statements: DataFrame, inventory: DataFrame) -> DataFrame:
    """PLAN of transactions' statements (txn, position, kind, path, source, content, old, new, overwrite) over an inventory (path, type, size, content).

    Each statement is judged against what the earlier ones of its transaction leave: a fold in order, one task a transaction. After a conflict nothing more of that
    transaction is planned. The files that a transaction names come to its task, with all below the folders that it deletes or moves; no others do.
    """
    named = statements.select("txn", F.explode(F.array_compact(F.array("path", "source"))).alias("_p"))
    # a named path, its folders above (are they there?), and what lies below it
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("_p", "/"))), lambda k: F.array_join(F.slice(F.split("_p", "/"), F.lit(1), k), "/"))
    whole = named.select("txn", F.explode(above).alias("path")).distinct()
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    below = inventory.withColumn("_p", F.explode(ends)).join(named.distinct(), "_p").select("txn", *inventory.columns)
    near = inventory.join(whole, "path").select("txn", *inventory.columns).unionByName(below).dropDuplicates(["txn", "path"])
    columns = ["txn", "position", "kind", "path", "source", "content", "old", "new", "overwrite"]
    facts = near.select("txn", F.lit(-1).cast("long").alias("position"), F.col("type").alias("kind"), "path", F.lit(None).cast("string").alias("source"), F.col("content").cast("string").alias("content"), F.col("size").cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(False).alias("overwrite"))
    rows = statements.select(*columns).unionByName(facts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Overlay | None = None
        for batch in batches:
            out = []
            for txn, position, kind, path, source, content, old, new, overwrite in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state.txn != txn:
                    state = Overlay(txn)
                if position < 0:
                    state.there[path] = (kind, int(old or 0), content)
                elif not state.failed:
                    effect, bytes_, error = state.step(kind, path, source, content, old, new, bool(overwrite))
                    out.append((txn, position, effect, bytes_, error))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["txn", "position", "effect", "rollback_bytes", "error"])

    return rows.repartition("txn").sortWithinPartitions("txn", "position", "path").mapInArrow(run, PLAN)


class Overlay:
    """A transaction's files: path to (type, size, content), with what its statements did."""

    def __init__(self, txn: str):
        self.txn, self.failed = txn, False
        self.there: dict[str, tuple[str, int, str | None]] = {}
        self.changed: set[str] = set()

    def below(self, path: str) -> list[str]:
        return [p for p in self.there if p.startswith(path + "/")]

    def bytes_at(self, path: str) -> int:
        return sum(self.there[p][1] for p in [path, *self.below(path)])

    def parent_error(self, path: str) -> str | None:
        parent = path.rpartition("/")[0]
        return "the parent is no folder" if parent and self.there.get(parent, ("",))[0] != "dir" else None

    def step(self, kind: str, path: str, source: str | None, content: str | None, old: str | None, new: str | None, overwrite: bool) -> tuple[str | None, int, str | None]:
        try:
            effect, bytes_ = getattr(self, f"_{kind}")(path, source, content, old, new, overwrite)
        except ValueError as e:
            self.failed = True
            return None, 0, str(e)
        return effect, bytes_, None

    def _fresh(self, path: str) -> None:
        if path in self.changed:
            raise ValueError("several statements change one target")

    def _mkdir(self, path, source, content, old, new, overwrite):  # noqa: ANN001, ANN202
        self._fresh(path)
        if path in self.there:
            if self.there[path][0] != "dir":
                raise ValueError("the target is there and no folder")
            return "noop", 0
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            self.there.setdefault("/".join(parts[:k]), ("dir", 0, None))
        self.changed.add(path)
        return "create", 0

    def _write(self, path, source, content, old, new, overwrite):  # noqa: ANN001, ANN202
        self._fresh(path)
        if error := self.parent_error(path):
            raise ValueError(error)
        before = self.there.get(path)
        if before and before[0] != "file":
            raise ValueError("the target is no regular file")
        self.there[path] = ("file", len((content or "").encode()), None)
        self.changed.add(path)
        return ("modify", before[1]) if before else ("create", 0)

    def _replace(self, path, source, content, old, new, overwrite):  # noqa: ANN001, ANN202
        self._fresh(path)
        before = self.there.get(path)
        if not before:
            raise ValueError("the target is missing")
        if before[0] != "file":
            raise ValueError("the target is no regular file")
        if (old or "") not in (before[2] or ""):
            raise ValueError("the text to replace is not there")
        if old == new:
            return "noop", 0
        self.changed.add(path)
        return "modify", before[1]

    def _delete(self, path, source, content, old, new, overwrite):  # noqa: ANN001, ANN202
        self._fresh(path)
        if path not in self.there:
            raise ValueError("the target is missing")
        if any(p.startswith(path + "/") for p in self.changed):
            raise ValueError("what lies below was changed before")
        bytes_ = self.bytes_at(path)
        for p in [path, *self.below(path)]:
            del self.there[p]
        self.changed.add(path)
        return "delete", bytes_

    def _transfer(self, path: str, source: str | None, overwrite: bool, moved: bool) -> tuple[str, int]:
        if source == path or path.startswith(f"{source}/"):
            raise ValueError("source and target are one")
        self._fresh(path)
        if moved:
            self._fresh(source)
        if source not in self.there:
            raise ValueError("the source is missing")
        if error := self.parent_error(path):
            raise ValueError(error)
        replaced = path in self.there
        if replaced and not overwrite:
            raise ValueError("the target is there")
        bytes_ = self.bytes_at(path) if replaced else 0
        for p in [path, *self.below(path)] if replaced else []:
            del self.there[p]
        for p in [source, *self.below(source)]:
            self.there[path + p[len(source) :]] = self.there[p]
            if moved:
                del self.there[p]
        self.changed |= {path, source} if moved else {path}
        return "overwrite" if replaced else "move" if moved else "create", bytes_

    def _copy(self, path, source, content, old, new, overwrite):  # noqa: ANN001, ANN202
        return self._transfer(path, source, overwrite, False)

    def _move(self, path, source, content, old, new, overwrite):  # noqa: ANN001, ANN202
        return self._transfer(path, source, overwrite, True)


def plan_summary(plans: DataFrame) -> DataFrame:
    """txn, a count for each effect, rollback_bytes, safe (no statement failed)."""
    return plans.groupBy("txn").agg(*(F.count_if(F.col("effect") == e).alias(e) for e in EFFECTS), F.sum("rollback_bytes").alias("rollback_bytes"), (F.count("error") == 0).alias("safe"))


def program(results: DataFrame) -> DataFrame:
    """results (program, position, name, status) with what is left of a program after a transaction that did not commit as SKIPPED."""
    before = Window.partitionBy("program").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max((F.col("status") != "COMMITTED").cast("int")).over(before), F.lit(0))
    return results.withColumn("status", F.when(failed == 1, "SKIPPED").otherwise(F.col("status")))


def frame(sequence: int, kind: int, payload: dict) -> bytes:
    """One journal frame as bytes."""
    body = json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()
    head = FRAME.pack(MAGIC, VERSION, kind, sequence, len(body))
    return head + body + struct.pack(">I", castagnoli(head[4:] + body))


def castagnoli(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def frames(path: str, data: bytes) -> list[tuple]:
    """path, sequence, kind, checked bytes, payload, checksum of a journal's whole frames."""
    at, rows = 0, []
    while at + FRAME.size <= len(data):
        magic, version, kind, sequence, length = FRAME.unpack_from(data, at)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path}: no journal frame at {at}")
        if sequence != len(rows) + 1:
            raise ValueError(f"{path}: sequence {sequence}, expected {len(rows) + 1}")
        end = at + FRAME.size + length
        if end + 4 > len(data):
            break
        rows.append((path, sequence, kind, data[at + 4 : end], data[at + FRAME.size : end].decode(), struct.unpack_from(">I", data, end)[0]))
        at = end + 4
    if not rows:
        raise ValueError(f"{path}: no whole frame")
    return rows


def journal(files: DataFrame) -> DataFrame:
    """path, sequence, kind, payload of journals (path, content); raises on bad magic, version, checksum or a gap in the sequence. A torn last frame is left out; a journal that holds no whole one raises.

    Frames are cut by their lengths in Python; checksums are built-in expressions over the cut frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = frames(path, content.as_py() or b"")
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64()))], names=["path", "sequence", "kind", "_bytes", "payload", "_crc"])

    cut = files.select("path", "content").mapInArrow(run, "path string, sequence long, kind int, _bytes binary, payload string, _crc long")
    good = F.when(crc32c(F.col("_bytes")) == F.col("_crc"), F.lit(True)).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": checksum of frame "), F.col("sequence"))).cast("boolean"))
    return cut.filter(good).select("path", "sequence", "kind", "payload")
