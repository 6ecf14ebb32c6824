"""Best-fit packing: pattern packing by non-negative least squares.

Only the histogram of piece lengths (at most `window` rows) comes to the driver. There, the patterns
that fill a sequence exactly are enumerated: all of one to three pieces, and all of two lengths, each any number of times; the
window alone bounds how many there are. Repeat counts x >= 0 are fitted so that the patterns' lengths reproduce the
histogram (least squares, accelerated projected gradient steps to a tolerance). They are rounded: whole parts first, then one
more by falling fraction, weighed by the longest piece (long ones are hard to place later), never more than the histogram holds. What that leaves is packed by best fit
decreasing, also on counts: a pattern is built greedily and repeated as often as the counts allow. Of a few shares of the tokens at which
rounding up stops, the one with the fewest sequences is taken, of equals the one that leaves least to best fit. Every pattern maps a range of ranks within each
of its lengths to sequence numbers, so each piece finds its place by itself, where it lies.

Ranks: pieces are numbered within (partition, length) as they are written; the partitions' offsets come
from a window over the counts, not over the pieces.

Edge cases: a null text is an empty one (just the end id). A text of any length is cut into pieces; a piece of a whole window is a
sequence. Repeated rows are packed each; pieces of one length are alike, and their ranks say which goes where. Null ids stay. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import few_rows, fresh_dir, open_fs, text_column, written
from tessera.llm.tokens import default_path, encoder

WINDOW = 2048
#: The fit ends when a step moves no more than this share of all repeats, and at the latest after MOST_STEPS.
SETTLED, MOST_STEPS = 1e-4, 3000
#: Shares of the tokens at which rounding up stops: so much is left to best fit.
LEFT = (0.0, 0.03, 0.1, 0.15, 0.25, 0.5, 1.0)
PIECE = "part long, rank_in_part long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """The documents' ids and end id, cut into pieces of at most `window` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end, width = np.array([end_id], "<u4").tobytes(), 4 * window
        for batch in few_rows(batches):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), worker.encode_column(text_column(batch))):
                ids += end
                for k in range(-(-len(ids) // width)):
                    cut = ids[k * width : (k + 1) * width]
                    n = len(cut) // 4
                    rows.append((part, int(seen[n]), doc, k, k * window, n, zlib.crc32(cut), cut if with_ids else None))
                    seen[n] += 1
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "rank_in_part", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def patterns(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times): rows of three lengths (0: none) and how often each comes, that fill a sequence with what the counts hold."""
    has = counts > 0
    has[0] = False
    present = np.flatnonzero(has)
    lengths, times = [], []

    def add(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, c: np.ndarray, k: np.ndarray) -> None:
        held = (counts[a] >= i) & (counts[b] >= j) & (counts[c] >= k)
        lengths.append(np.stack([a, b, c], 1)[held])
        times.append(np.stack([i, j, k], 1)[held])

    zero = np.zeros(1, np.int64)
    for a in present.tolist():
        most = min(int(counts[a]), window // a)
        i = np.arange(1, most + 1)
        whole = i[i * a == window]
        if len(whole):
            add(whole * 0 + a, whole, whole * 0, whole * 0, whole * 0, whole * 0)
        # two lengths, each any number of times: b < a divides what i times a leaves
        b = present[present < a]
        if len(b):
            gap = window - i * a
            row, at = np.nonzero((gap[:, None] > 0) & (gap[:, None] % b == 0))
            none = np.zeros(len(row), np.int64)
            add(none + a, i[row], b[at], gap[row] // b[at], none, none)
        # three different lengths a > b > c
        b = b[(2 * b > window - a) & (b < window - a)]
        b = b[has[window - a - b]]
        one = np.ones(len(b), np.int64)
        add(one * a, one, b, one, window - a - b, one)
    if not lengths:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
    return np.concatenate(lengths), np.concatenate(times)


def fit(counts: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """x >= 0 for which the patterns' summed lengths come nearest to the counts: accelerated projected gradient, each pattern with a step of its own."""
    flat, size = lengths.ravel(), len(counts)
    weight = np.where(lengths > 0, times, 0).astype(float)
    # a diagonal that bounds the quadratic form from above, so that no step overshoots
    row_sums = np.bincount(flat, weights=weight.ravel(), minlength=size)
    # a pattern that holds a length often gets a shorter step by itself
    step = 1 / np.maximum(1e-9, (weight * row_sums[lengths]).sum(1))
    x = y = np.zeros(len(lengths))
    momentum = 1.0
    for _ in range(MOST_STEPS):
        left = counts - np.bincount(flat, weights=(weight * y[:, None]).ravel(), minlength=size)
        new = np.maximum(0, y + (weight * left[lengths]).sum(1) * step)
        moved = new - x
        if float(moved @ (y - new)) > 0:  # the momentum points the wrong way
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / following * moved
        x, momentum = new, following
        if np.abs(moved).sum() <= SETTLED * x.sum():
            break
    return x


def rounded(counts: np.ndarray, lengths: np.ndarray, times: np.ndarray, x: np.ndarray, share: float) -> tuple[np.ndarray, list[tuple[dict[int, int], int]]]:
    """What is left of the counts, and the patterns with their repeats: whole parts, then one more by falling weighed fraction until `share` of the tokens is left."""
    left, out = counts.astype(np.int64).tolist(), {}
    whole = np.floor(x + 1e-9).astype(np.int64)
    fraction = np.maximum(0, x - whole)
    first = np.flatnonzero(whole > 0)
    first = first[np.argsort(-x[first], kind="stable")]
    more = np.flatnonzero(fraction > 1e-6)
    more = more[np.argsort(-fraction[more] * lengths[more].max(1), kind="stable")]
    tokens = int((np.arange(len(counts)) * counts).sum())
    least, window = int(share * tokens), int((lengths * times).sum(1).max())
    for rows, wanted in ((first, whole), (more, None)):
        if wanted is None:
            tokens -= window * sum(out.values())
        for row, (a, b, c), (i, j, k) in zip(rows.tolist(), lengths[rows].tolist(), times[rows].tolist()):
            n = min(left[a] // i if a else 1 << 60, left[b] // j if b else 1 << 60, left[c] // k if c else 1 << 60)
            n = min(n, 1 if wanted is None else int(wanted[row]))
            if wanted is None and n > 0:
                if tokens <= least:
                    break
                tokens -= window
            if n > 0:
                left[a] -= n * i
                left[b] -= n * j
                left[c] -= n * k
                out[row] = out.get(row, 0) + n
    left[0] = 0
    found = [({int(length): int(t) for length, t in zip(lengths[row], times[row]) if length}, n) for row, n in out.items()]
    return np.array(left, np.int64), found


def best_fit(counts: np.ndarray, window: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on counts."""
    left, out = counts.copy(), []
    while left.any():
        gap, pattern, trial = window, {}, left.copy()
        while gap > 0 and len(open_ := np.flatnonzero(trial[: gap + 1])):
            best = int(open_[-1])
            n = min(gap // best, int(trial[best]))
            pattern[best] = pattern.get(best, 0) + n
            trial[best] -= n
            gap -= n * best
        n = min(int(left[k]) // v for k, v in pattern.items())
        for k, v in pattern.items():
            left[k] -= n * v
        out.append((pattern, n))
    return out


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """[(pattern as {length: pieces}, repeats)] that uses every count exactly once. counts[n]: pieces of length n."""
    return fitted_plan(counts, window)[0]


def fitted_plan(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[dict[int, int], int]], int]:
    """plan(), and how many of its first entries are patterns of the fit."""
    lengths, times = patterns(counts, window)
    x = fit(counts, lengths, times) if len(lengths) else np.zeros(0)
    best = None
    for share in LEFT if len(lengths) else ():
        left, found = rounded(counts, lengths, times, x, share)
        rest = best_fit(left, window)
        cost = (sum(n for _, n in found) + sum(n for _, n in rest), sum(n for _, n in rest))
        if best is None or cost < best[0]:
            best = cost, found + rest, len(found)
    return (best[1], best[2]) if best else (best_fit(counts, window), 0)


def places(found: list[tuple[dict[int, int], int]], window: int) -> dict[str, np.ndarray]:
    """Where rank r of length n goes: the first row with the key n * 2**44 + r or less; sequence = base + r - first rank."""
    keys, base, offset = [], [], []
    next_rank, sequence = np.zeros(window + 1, np.int64), 0
    for pattern, times in found:
        at = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                keys.append(length * 2**44 + int(next_rank[length]))
                base.append(sequence)
                offset.append(at)
                next_rank[length] += times
                at += length
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return {"keys": np.array(keys, np.int64)[order], "base": np.array(base, np.int64)[order], "offset": np.array(offset, np.int64)[order]}


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (null if not with_ids), sequence_id, offset of every piece.

    The pieces stay where they are written: a worker reads the rank offsets of the partitions that it meets, at most `window` numbers each.
    """
    folder = fresh_dir(docs.sparkSession, "ranks")
    rows = written(pieces(docs, path or default_path(), window, end_id, with_ids), "pieces")
    by_part = written(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    before.select("part", "length", "before").repartition("part").write.partitionBy("part").parquet(folder)
    counts = np.zeros(window + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[row.length] = row.n
    where = places(plan(counts, window), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in few_rows(batches):
            part, rank, length = (batch.column(i).to_numpy() for i in range(3))
            for p in np.unique(part).tolist():
                if p not in known:
                    fs, top = open_fs(f"{folder}/part={p}")
                    offsets = pq.read_table(top, filesystem=fs, partitioning=None)
                    known[p] = np.zeros(window + 1, np.int64)
                    known[p][offsets["length"].to_numpy()] = offsets["before"].to_numpy()
                at = part == p
                rank = np.where(at, rank + known[p][np.where(at, length, 0)], rank)
            key = length * 2**44 + rank
            at = np.searchsorted(where["keys"], key, side="right") - 1
            yield pa.record_batch([*batch.columns[3:], batch.column(2), pa.array(where["base"][at] + key - where["keys"][at]), pa.array(where["offset"][at])], names=[*batch.schema.names[3:], "length", "sequence_id", "offset"])

    ranked = rows.select("part", "rank_in_part", "length", "doc_id", "piece", "start", "ids_crc32", "ids")
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, ids_crc32 long, ids binary, length long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("ids")
