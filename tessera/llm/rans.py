"""Token-ID output: archives of static range asymmetric numeral system blocks.

One frequency table, counted over the whole corpus, is shared by all files. A block holds whole
documents; its ids are dealt over LANES interleaved coders, so that a block decodes in vector steps.
Every CHECK_ROWS rows the coders' states are kept with the place in the word stream (a checkpoint),
so that a reader can also start inside a block, and each block carries a CRC-32 of its bytes and
one of its ids.

File: MAGIC, block..., each block at an offset that the manifest table holds. Block: header (see
HEADER), doc ids (i64; null as the lowest value), doc lengths (i64), lane states at row 0 (u64), checkpoints
(row u32, word offset u32, states u64 each), words (u32). All little-endian.

Edge cases: a null text is an empty one (just the end id). Rows with the same doc_id stay separate
documents, ordered by text. Null ids come first. An empty table gives no files and no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import few_rows, fresh_dir, open_fs, text_column, written
from tessera.llm.tokens import default_path, encoder

MAGIC = b"TSRANS01"
LANES = 512
SCALE_BITS = 20
LOW = 1 << 31
CHECK_ROWS = 256
BLOCK_TOKENS = 1 << 18
#: block CRC, ids CRC, documents, ids, words, checkpoints, first id's number in the corpus
HEADER = struct.Struct("<IIQQQQq")
NULL_ID = -(1 << 63)


def table(counts: np.ndarray, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**scale_bits, at least 1 for each id that occurs."""
    total, size = int(counts.sum()), 1 << scale_bits
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    seen = np.flatnonzero(counts)
    if len(seen) > size:
        raise ValueError("more ids than slots")
    freq[seen] = np.maximum(1, counts[seen].astype(float) * size / total).astype(np.int64)
    order = seen[np.argsort(-freq[seen], kind="stable")]
    gap = size - int(freq.sum())
    if gap > 0:
        freq[order[0]] += gap
    while gap < 0:
        cut = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -gap // size))
        cut = np.where(np.cumsum(cut) <= -gap, cut, np.maximum(0, -gap - (np.cumsum(cut) - cut)))
        freq[order] -= cut
        gap += int(cut.sum())
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, scale_bits: int = SCALE_BITS):
        self.bits = np.uint64(scale_bits)
        self.mask = np.uint64((1 << scale_bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - scale_bits)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """(states at row 0, words, checkpoints)"""
        state, out, rows, marks, count = np.full(LANES, LOW, np.uint64), [], -(-len(ids) // LANES), [], 0
        for row in range(rows - 1, -1, -1):
            if row + 1 < rows and (row + 1) % CHECK_ROWS == 0:
                marks.append((row + 1, count, state.copy()))
            part = ids[row * LANES : (row + 1) * LANES]
            x, freq = state[: len(part)], self.freq[part]
            full = x >= self.limit[part]
            if full.any():
                out.append(x[full].astype(np.uint32))
                count += len(out[-1])
                x = np.where(full, x >> np.uint64(32), x)
            quotient = x // freq
            state[: len(part)] = (quotient << self.bits) + (x - quotient * freq) + self.start[part]
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        return state, words, [(row, len(words) - back, s) for row, back, s in reversed(marks)]

    def decode(self, state: np.ndarray, words: np.ndarray, n: int, row: int = 0, at: int = 0) -> np.ndarray:
        """ids of rows from `row` on, starting from that row's states and word offset."""
        state, out = state.copy(), np.empty(n - row * LANES, np.uint32)
        for first in range(0, len(out), LANES):
            x = state[: min(LANES, len(out) - first)]
            slot = x & self.mask
            ids = self.symbol[slot.astype(np.int64)]
            out[first : first + len(x)] = ids
            x = self.freq[ids] * (x >> self.bits) + slot - self.start[ids]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
                at += len(low)
            state[: len(x)] = x
        return out


def pack_block(coder: Coder, doc_ids: list[int], lengths: list[int], ids: np.ndarray, first: int) -> bytes:
    state, words, marks = coder.encode(ids)
    body = b"".join([np.array(doc_ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), state.astype("<u8").tobytes(), *(struct.pack("<II", r, w) + s.astype("<u8").tobytes() for r, w, s in marks), words.astype("<u4").tobytes()])
    head = HEADER.pack(0, zlib.crc32(ids.astype("<u4").tobytes()), len(doc_ids), len(ids), len(words), len(marks), first)
    return struct.pack("<I", zlib.crc32(head[4:] + body)) + head[4:] + body


def unpack_block(coder: Coder, block: bytes, from_checkpoint: int | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(doc ids, lengths, number of the first id, ids); with from_checkpoint, the ids from that checkpoint on."""
    crc, ids_crc, docs, n, n_words, n_marks, first = HEADER.unpack_from(block)
    if zlib.crc32(block[4:]) != crc:
        raise ValueError("damaged block")
    at = HEADER.size
    doc_ids, lengths = np.frombuffer(block, "<i8", docs, at), np.frombuffer(block, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    state = np.frombuffer(block, "<u8", LANES, at)
    at += 8 * LANES
    marks, step = at, 8 + 8 * LANES
    words = np.frombuffer(block, "<u4", n_words, at + n_marks * step).astype(np.uint64)
    if from_checkpoint is not None:
        row, word = struct.unpack_from("<II", block, marks + from_checkpoint * step)
        return doc_ids, lengths, first, coder.decode(np.frombuffer(block, "<u8", LANES, marks + from_checkpoint * step + 8), words, n, row, word)
    ids = coder.decode(state, words, n)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("decoded ids differ from those encoded")
    return doc_ids, lengths, first, ids


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Range-partitioned by doc_id and ordered within: part, doc_id, local_start, n_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, part, start = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in few_rows(batches):
            ids = [x + end for x in worker.encode_column(text_column(batch))]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            before = start + np.cumsum(n) - n
            start += int(n.sum())
            yield pa.record_batch({"part": pa.array(np.full(len(n), part, np.int64)), "doc_id": batch.column(0), "local_start": pa.array(before), "n_tokens": pa.array(n), "ids": pa.array([np.frombuffer(x, "<u4").astype("<u2").tobytes() if worker.size <= 65536 else x for x in ids], pa.binary())})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_hash", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").drop("_hash")
    return ordered.mapInArrow(run, "part long, doc_id long, local_start long, n_tokens long, ids binary")


def id_type(path: str) -> str:
    return "<u2" if encoder(path).size <= 65536 else "<u4"


def counted(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id occurs over all rows; as many rows as the vocabulary come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                counts += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size) if len(x.as_buffer()) > size // 8 else 0
            small = b"".join(x.as_py() for x in batch.column(0) if len(x.as_buffer()) <= size // 8)
            counts += np.bincount(np.frombuffer(small, kind), minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.record_batch({"id": pa.array(seen), "n": pa.array(counts[seen])})

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def write_archive(docs: DataFrame, path: str | None = None, end_id: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Writes the ids of all documents in ascending doc_id order; gives the manifest (a written table) and the shared frequencies."""
    spark, path = docs.sparkSession, path or default_path()
    tokens, kind, size = written(tokenised(docs, path, end_id), "ids"), id_type(path), encoder(path).size
    freq = table(counted(tokens, size, kind))
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    before = dict(zip([p.part for p in parts], (np.cumsum([p.n for p in parts]) - [p.n for p in parts]).tolist())) if parts else {}
    folder = fresh_dir(spark, "archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        coder, name, made = Coder(freq), f"{uuid.uuid4().hex}.rans", []
        held: list = [[], [], [], 0, 0]

        def flush(file) -> None:
            ids, lengths, parts_, n, first = held
            if ids:
                block = pack_block(coder, ids, lengths, np.frombuffer(b"".join(parts_), kind).astype(np.int64), first)
                made.append((file.tell(), len(block), len(ids), n))
                file.write(block)
            held[:] = [[], [], [], 0, 0]

        file, expected = None, None
        for batch in batches:
            for part, doc, start, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if file is None:
                    file = fs.open_output_stream(f"{top}/{name}")
                    file.write(MAGIC)
                first = before[part] + start
                if held[0] and (held[3] >= BLOCK_TOKENS or first != expected):
                    flush(file)
                if not held[0]:
                    held[4] = first
                held[0].append(NULL_ID if doc is None else doc)
                held[1].append(n)
                held[2].append(ids)
                held[3] += n
                expected = first + n
        if file is not None:
            flush(file)
            file.close()
            yield pa.record_batch({"file": pa.array([name] * len(made))} | {k: pa.array(v, pa.int64()) for k, v in zip(("offset", "length", "docs", "tokens"), zip(*made))})

    manifest = tokens.select("part", "doc_id", "local_start", "n_tokens", "ids").mapInArrow(run, "file string, offset long, length long, docs long, tokens long")
    return written(manifest.withColumn("folder", F.lit(folder)), "manifest"), freq


def read_archive(manifest: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document in the files that the manifest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for folder, name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fs, top = open_fs(folder)
                with fs.open_input_file(f"{top}/{name}") as file:
                    if file.read_at(len(MAGIC), 0) != MAGIC:
                        raise ValueError(f"{name} is not an archive")
                    block = file.read_at(length, offset)
                docs, lengths, first, ids = unpack_block(coder, block)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch({"doc_id": pa.array(docs, mask=docs == NULL_ID), "start": pa.array(first + ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "ids": pa.array(cut, pa.binary())})

    blocks = manifest.select("folder", "file", "offset", "length").repartition(max(12, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op9_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, freq = write_archive(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_archive(manifest, freq).drop("ids")
