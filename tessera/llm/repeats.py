"""Exact removal of repeated byte strings by a run-length index (suffix-array dedup).

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in the same document or
another. Strings are dealt by anchors (see anchors()): equal strings have the same anchor hash, so
1. anchor hashes that occur once drop out after a partial aggregate of their counts;
2. the runs of strings of the other anchors become contexts: each different one once (by a 128-bit hash), with its number as weight;
3. contexts go by anchor to buckets of bounded size. A bucket's run-compressed Burrows-Wheeler transform is that of all copies: copies
   only lengthen its runs, so they enter as weights. The suffixes at both ends of its runs are sampled; from these samples the
   longest match of every place with another place is streamed through the text, and starts with LENGTH or more are marked.
An anchor with more contexts than a bucket takes is split until it fits: the strings by how far they reach to the left of the
anchor, in halves of halves; those of one part share more bytes, which are the part's key. Parts of one string each
share all bytes, so any anchor ends in buckets. Hot passages and groups of copies are one row a context from the first map-side
aggregate on, and no join has a hot key on a side that can't be split.

Edge cases: a null text is an empty one. Texts under LENGTH bytes keep all. Copies of a document remove each other
whole, repeated rows (same doc_id and text) too. Null doc_ids stay. Removal is by bytes for the digest; the text that
deduplicated() returns keeps characters whole: one that is cut by a span's end stays. A text of any length is taken whole, in
overlapping parts. An empty table gives no rows. The operator's own columns are prefixed, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import few_rows, sheltered, slices, text_bytes, text_column, written
from tessera.llm.wordhash import mixed, prefix, span_hashes

LENGTH = 200
SEED = 32
PLACE_BITS = 24
CHUNK = 1 << 20
#: Three numbers of so many bits make one sort key, so that is the most a bucket can have; BUCKET keeps a worker small.
INDEX_BITS = 21
BUCKET = 1 << 19
SYMBOL_BITS = 9
FIRST = 4
#: A document's bytes that one call of anchors() takes; longer ones are taken in overlapping parts. A call takes some 80 bytes of memory for each.
PART = 1 << 20
ANCHOR = "_doc long, _tag long, _start long, _count int, _left int, _seed long, _context long, _check long"
CONTEXT = ["_seed", "_context", "_check"]
#: A part of a split anchor has the strings whose reach to the left lies in one block of so many bytes, halved from split to split.
WIDEST = 128


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, seed: int, seeds_only: bool = False) -> tuple[np.ndarray, ...]:
    """For all strings of `length` bytes inside documents, of each run of them with one anchor: its seed hash, then (unless seeds_only) row, first start, number of starts, how far the first start lies before the anchor, and the context's two hashes.

    A string's anchor is the place in it of the least hash of `seed` bytes, the leftmost of equals. It depends on the
    string alone, so equal strings have equal anchor hashes at equal distances, and only runs with the same seed hash
    can hold equal strings.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return (none,) * (1 if seeds_only else 7)
    sums = prefix(data)
    at = np.arange(len(data) - seed + 1)
    hashes = span_hashes(sums, at, at + seed)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((hashes & ~low) | at.astype(np.uint64), length - seed + 1)
    place = (least & low).astype(np.int64)
    del least
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    valid = np.arange(len(place)) + length <= np.repeat(offsets[1:], sizes)[: len(place)]
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]) & (row[1:] == row[:-1]))
    starts = np.flatnonzero(first)
    anchor = place[starts]
    if seeds_only:
        return (hashes[anchor].view(np.int64),)
    count = np.add.reduceat(valid, starts) if len(starts) else none
    left, ends = anchor - starts, starts + count - 1 + length
    shape = (left * 1024 + count).astype(np.uint64)
    context, check = (mixed(span_hashes(prefix(data, k) if k else sums, starts, ends, k) ^ shape).view(np.int64) for k in (0, 1))
    return hashes[anchor].view(np.int64), row[starts], starts - offsets[row[starts]], count, left, context, check


def anchor_rows(docs: DataFrame, length: int, seed: int, seeds_only: bool = False) -> DataFrame:
    """The anchors of all texts, or their seed hashes alone. docs: _doc, _tag, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            raw, at = text_bytes(text_column(batch))
            for first, end in slices(at, CHUNK):
                for part in range(int(at[first]), max(int(at[end]) - length + 1, int(at[first]) + 1), PART):
                    if end - first > 1 or part + PART + length - 1 >= at[end] and part == at[first]:
                        found = anchors(raw[at[first] : at[end]], at[first : end + 1] - at[first], length, seed, seeds_only)
                    else:
                        data = raw[part : min(int(at[end]), part + PART + length - 1)]
                        found = anchors(data, np.array([0, len(data)]), length, seed, seeds_only)
                    if len(found[0]) and seeds_only:
                        yield pa.record_batch([pa.array(found[0])], names=["_seed"])
                    elif len(found[0]):
                        hashes, row, start, count, left, context, check = found
                        where = pa.array(first + row)
                        start = start + (part - int(at[first]) if end - first == 1 else 0)
                        yield pa.record_batch([ids.take(where), tags.take(where), pa.array(start), pa.array(count.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(hashes), pa.array(context), pa.array(check)], names=["_doc", "_tag", "_start", "_count", "_left", *CONTEXT])
                    if end - first > 1:
                        break

    return docs.select("_doc", "_tag", "text").mapInArrow(run, "_seed long" if seeds_only else ANCHOR)


class RunIndex:
    """The run-compressed transform of a text of symbols, with the suffixes at its runs' heads and tails. Symbol 0 ends a part; no two ends are equal, so none share a run.

    weights: how many copies of the text's parts there are, a number for each place; a run's length counts its suffixes so often.
    heads, tails: places in the text of the first and last suffix of each run; head_match, tail_match: how long the
    head's match with the suffix before it is, and the tail's with the one after it, if it may be `least` or more. Inside a run, the suffix one place on has
    a match shorter by one, so these samples hold the longest match of every place. A part with copies begins a run of its own
    kind (nothing precedes it), and its first place matches the copy's to the part's end: `copied` has these.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray | None = None, copied: dict[str, np.ndarray] | None = None, least: int = 1):
        n = self.n = len(symbols)
        self.symbols, self.copied = symbols, copied
        bits, mask = np.uint64(INDEX_BITS), np.uint64((1 << INDEX_BITS) - 1)
        padded = np.zeros(n + FIRST, np.uint64)
        padded[:n] = symbols
        key, ends = np.zeros(n, np.uint64), np.zeros(n, bool)
        for k in range(FIRST):
            ends |= padded[k : n + k] == 0
            key = key << np.uint64(SYMBOL_BITS) | np.where(ends, 0, padded[k : n + k]).astype(np.uint64)  # ends differ, in the order of their places
        # a suffix's rank is the slot of the first of its group of equals, and one more; only groups of several are sorted again
        order, rank, slots = np.zeros(n, np.int64), np.zeros(n + 1, np.int32), np.arange(n)
        self.ranks, self.depths, depth, active = [], [], FIRST, np.arange(n, dtype=np.uint64)
        while True:
            ordered = np.sort(key << bits | active)
            found, kept = (ordered & mask).astype(np.int64), ordered >> bits
            fresh = np.ones(len(slots), bool)
            fresh[1:] = kept[1:] != kept[:-1]
            if depth == FIRST:
                fresh |= ends[found]
            order[slots] = found
            rank = rank.copy()
            rank[found] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
            self.ranks.append(rank)
            self.depths.append(depth)
            several = ~fresh
            several[:-1] |= ~fresh[1:]
            if not several.any():
                break
            slots, at = slots[several], found[several]
            # beyond the end: rank 0
            key, active = rank[at].astype(np.uint64) << bits | rank.take(at + depth, mode="clip").astype(np.uint64), at.astype(np.uint64)
            depth *= 2
        before = np.full(n, -1, np.int32)  # what precedes each suffix; nothing precedes the text
        before[order > 0] = symbols[order[order > 0] - 1]
        change = np.ones(n + 1, bool)
        change[1:n] = (before[1:] != before[:-1]) | (before[1:] <= 0)
        heads, tails = np.flatnonzero(change[:n]), np.flatnonzero(change[1:])
        self.run_symbols = before[heads]
        self.run_lengths = tails - heads + 1 if weights is None else np.add.reduceat(weights[order], heads) if n else heads
        self.heads, self.tails = order[heads], order[tails]
        self.head_match = self._match(self.heads, order[np.maximum(heads - 1, 0)], heads > 0, least)
        self.tail_match = self._match(self.tails, order[np.minimum(tails + 1, n - 1)], tails < n - 1, least)
        del self.ranks, self.symbols

    def _match(self, a: np.ndarray, b: np.ndarray, there: np.ndarray, least: int) -> np.ndarray:
        """How many symbols the suffixes at a and b share (distinct places, so the ranks' depths can tell); 0 where it is known to be under `least`."""
        out = np.zeros(len(a), np.int64)
        far = np.searchsorted(self.depths, least, side="right") - 1
        at = np.flatnonzero(there & (self.ranks[far][a] == self.ranks[far][b]) if far >= 0 else there)
        a, b, length = a[at], b[at], np.zeros(len(at), np.int64)
        for rank, depth in zip(self.ranks[::-1], self.depths[::-1]):
            same = (a < self.n) & (b < self.n) & (rank.take(a, mode="clip") == rank.take(b, mode="clip"))
            step = same * depth
            length, a, b = length + step, a + step, b + step
        open_ = np.ones(len(a), bool)
        for _ in range(FIRST - 1):
            open_ &= (a < self.n) & (b < self.n)
            open_[open_] = (self.symbols[a[open_]] == self.symbols[b[open_]]) & (self.symbols[a[open_]] != 0)
            length, a, b = length + open_, a + open_, b + open_
        out[at] = length
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each place the length of its longest match with any other place or copy, from the sampled run ends alone."""
        out = np.zeros(self.n, np.int64)
        samples = [(self.heads, self.head_match), (self.tails, self.tail_match)]
        if self.copied is not None:
            samples.append((self.copied["places"], self.copied["match"]))
        for places, match in samples:
            known = np.full(self.n, -1, np.int64)
            known[places] = match
            last = np.maximum.accumulate(np.where(known >= 0, np.arange(self.n), -1))
            out = np.maximum(out, np.where(last >= 0, known[last] - (np.arange(self.n) - last), 0))
        return out


def repeated_starts(contexts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """Of each context, whether the string of `length` bytes at each start occurs at another place of the contexts or in a copy."""
    sizes, copies = np.array([len(c) for c in contexts]), np.array(weights)
    symbols = np.zeros(int(sizes.sum()) + len(contexts), np.int32)
    begin = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[begin + sizes] = False
    symbols[inside] = raw.astype(np.int32) + 1
    index = RunIndex(symbols, np.repeat(copies, sizes + 1), {"places": begin, "match": np.where(copies > 1, sizes, 0)}, length)
    match = index.matching_statistics()
    return [match[b : b + s - length + 1] >= length for b, s in zip(begin.tolist(), sizes.tolist())]


def spans_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


MARKS = "_seed long, _context long, _check long, _from int, _n int"
PART_ROW = "_seed long, _context long, _check long, _weight long, _left int, _bytes binary, _parent_seed long, _parent_context long, _parent_check long, _offset int"


def bucket_marks(contexts: DataFrame, length: int, bucket: int) -> DataFrame:
    """Repeated starts of the contexts of each anchor, relative to the context. contexts: CONTEXT, _weight, _bytes; of no anchor more than a bucket takes."""

    def settle(held: list[tuple]) -> pa.RecordBatch | None:
        flagged = repeated_starts([h[4] for h in held], [h[3] for h in held], length)
        out = [(*h[:3], a, n) for h, flags in zip(held, flagged) for a, n in spans_of(flags)]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=[*CONTEXT, "_from", "_n"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, own = 0, 0  # symbols held, and from which row on the last anchor's are
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not held or held[-1][0] != row[0]:
                    own = len(held)
                if size + len(row[4]) + 1 > bucket and own:
                    if (out := settle(held[:own])) is not None:
                        yield out
                    held = held[own:]
                    size, own = sum(len(h[4]) + 1 for h in held), 0
                held.append(row)
                size += len(row[4]) + 1
        if held and (out := settle(held)) is not None:
            yield out

    return contexts.select(*CONTEXT, "_weight", "_bytes").repartition("_seed").sortWithinPartitions(*CONTEXT).mapInArrow(run, MARKS)


def parts_of(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """The contexts cut into the parts of their strings that reach to the left by blocks of `width` bytes: PART_ROW, keyed by the bytes that all strings of a block share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            out = []
            for seed, context, check, weight, left, raw in zip(*(c.to_pylist() for c in batch.columns)):
                least = left - (len(raw) - length)  # of the last start
                for block in range(least // width, left // width + 1):
                    high, low = min(left, (block + 1) * width - 1), max(least, block * width)
                    own = raw[left - high : left - low + length]
                    # what any string of the block covers: from block * width bytes before the anchor on
                    shared = raw[left - block * width :][: length - width + 1] if block * width <= left else b""
                    key, name = (hashlib.blake2b(x, digest_size=n).digest() for x, n in ((b"%d %d " % (block, seed) + shared, 8), (b"%d " % high + own, 16)))
                    out.append((int.from_bytes(key, "little", signed=True), int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), weight, high, own, seed, context, check, left - high))
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), (*[pa.int64()] * 4, pa.int32(), pa.binary(), *[pa.int64()] * 3, pa.int32()))], names=[*CONTEXT, "_weight", "_left", "_bytes", "_parent_seed", "_parent_context", "_parent_check", "_offset"])

    return contexts.select(*CONTEXT, "_weight", "_left", "_bytes").mapInArrow(run, PART_ROW)


def context_marks(contexts: DataFrame, length: int, bucket: int, width: int = WIDEST) -> DataFrame:
    """bucket_marks() of all contexts, the anchors that no bucket takes split first (see the module)."""
    sizes = contexts.groupBy("_seed").agg(F.sum(F.octet_length("_bytes") + 1).alias("_size")).filter(F.col("_size") > bucket)
    hot = written(sizes.select("_seed"), "hot")
    if hot.isEmpty() or width < 1:
        return bucket_marks(contexts, length, bucket)
    parts = written(parts_of(contexts.join(hot, "_seed", "left_semi"), length, width), "parts")
    merged = parts.groupBy(*CONTEXT).agg(F.sum("_weight").alias("_weight"), F.first("_left").alias("_left"), F.first("_bytes").alias("_bytes"))
    inner = written(context_marks(written(merged, "contexts"), length, bucket, width // 2), "marks")
    parents = parts.select(*CONTEXT, "_parent_seed", "_parent_context", "_parent_check", "_offset").join(inner, CONTEXT)
    up = parents.select(F.col("_parent_seed").alias("_seed"), F.col("_parent_context").alias("_context"), F.col("_parent_check").alias("_check"), (F.col("_offset") + F.col("_from")).alias("_from"), "_n")
    return bucket_marks(contexts.join(hot, "_seed", "left_anti"), length, bucket).unionByName(up)


def packed(docs: DataFrame) -> DataFrame:
    """docs with _doc, _tag (together a row's key) and _packed, the text's compressed bytes, in place of text."""
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("_doc", T.LongType()), T.StructField("_tag", T.LongType()), T.StructField("_packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in few_rows(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in [*rest, "_doc", "_tag"]), pa.array([packer.compress((t or "").encode()) for t in texts], pa.binary())], names=[*rest, "_doc", "_tag", "_packed"])

    return keyed(docs).mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    """With _doc (null as the lowest number) and _tag, a 64-bit hash of the text, so that rows which share a doc_id are told apart."""
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_tag": F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))})


def context_bytes(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """CONTEXT, _weight, _left, _bytes. wanted: _doc, _tag, _list of the contexts to take from a document."""
    schema = "_seed long, _context long, _check long, _weight long, _left int, _bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in few_rows(batches, 200):
            out = []
            for text, wants in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = unpacker.decompress(text.as_py())
                out += [(w["_seed"], w["_context"], w["_check"], w["_weight"], w["_left"], raw[w["_start"] : w["_start"] + w["_count"] - 1 + length]) for w in wants]
            for k in range(0, len(out), 20_000):
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out[k : k + 20_000]), (*[pa.int64()] * 4, pa.int32(), pa.binary()))], names=[*CONTEXT, "_weight", "_left", "_bytes"])

    # a row that repeats is one of each task after the partial aggregate
    texts = packed(docs.select("doc_id", "text")).groupBy("_doc", "_tag").agg(F.first("_packed").alias("_packed"))
    return texts.join(wanted, ["_doc", "_tag"]).select("_packed", "_list").mapInArrow(run, schema)


def marked(docs: DataFrame, length: int = LENGTH, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """_doc, _tag, _marks: runs (start, count) of starts of repeated strings, for the documents that have any."""
    rows = keyed(docs.select("doc_id", "text"))
    repeated = anchor_rows(rows, length, seed, seeds_only=True).groupBy("_seed").agg(F.count("*").alias("_c")).filter("_c > 1")
    repeated = written(repeated.select("_seed"), "seeds")
    found = written(anchor_rows(rows, length, seed).join(repeated, "_seed"), "anchors")
    classes = found.groupBy(*CONTEXT).agg(F.count("*").alias("_weight"), F.min(F.struct("_doc", "_tag", "_start", "_count", "_left")).alias("_r"))
    wanted = classes.groupBy("_r._doc", "_r._tag").agg(F.collect_list(F.struct(*CONTEXT, "_weight", "_r._left", "_r._start", "_r._count")).alias("_list"))
    contexts = written(context_bytes(wanted, docs, length), "bytes")
    marks = written(context_marks(contexts, length, bucket), "marks")
    every = found.select(*CONTEXT, "_doc", "_tag", "_start").join(marks, CONTEXT).select("_doc", "_tag", F.struct((F.col("_start") + F.col("_from")).alias("s"), F.col("_n").alias("n")).alias("_m"))
    return written(every.groupBy("_doc", "_tag").agg(F.collect_list("_m").alias("_marks")), "marks")


def removed_spans(marks: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Disjoint, maximal byte spans that the repeated strings cover."""
    out: list[list[int]] = []
    for a, b in sorted((m["s"], m["s"] + m["n"] - 1 + length) for m in marks or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they cut."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(docs: DataFrame, length: int = LENGTH, with_text: bool = True, **more: int) -> DataFrame:
    """The columns of docs (without text), what is left of the text in whole characters (null if not with_text), the digest's columns and the removed spans."""
    rest = [c for c in docs.columns if c != "text"]
    joined = packed(docs).join(marked(docs, length, **more), ["_doc", "_tag"], "left").select(*rest, "_packed", "_marks")
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("text", T.StringType()), *T._parse_datatype_string(DIGEST).fields, T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in few_rows(batches):
            rows, texts = [], []
            for text, marks in zip(batch.column(len(rest)), batch.column(len(rest) + 1).to_pylist()):
                raw = unpacker.decompress(text.as_py())
                spans = removed_spans(marks, length)
                kept = without(raw, spans)
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [list(s) for s in spans]))
                texts.append(without(raw, whole_characters(raw, spans)).decode() if with_text else None)
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))))]
            yield pa.record_batch([*batch.columns[: len(rest)], pa.array(texts, pa.string()), *columns], names=schema.names)

    return joined.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, **more: int) -> DataFrame:
    """docs with what is left of the texts; a column n_chars is set anew."""
    rows, restored = sheltered(docs, "doc_id", "text")
    out = restored(cut(rows, **more))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut(docs, with_text=False).drop("text", "spans")
