"""Language ID: a byte convolutional network trained in numpy.

Filters of several widths run over the bytes of a fixed-length window; each is max-pooled over the window and
a softmax layer reads the pools. It is trained on at most WINDOWS_PER_LANGUAGE windows for each label,
chosen by hash over all labelled rows (that bound is the only sample). A text is cut into windows from
its first byte to its last, the last padded with blanks; a text's scores are its windows' probabilities,
weighted by their bytes.

Texts never move: the training windows are cut and the predictions made where a text is read.

Edge cases: a null text, and one without a letter, is `und` with score 0; a very long one is scored over all its windows. Without any labelled row all are `und`. Ties go to the
label that is first by code point. A null doc_id is not held out. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import slices, text_bytes, text_column
from tessera.llm.wordhash import LOWER

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
WINDOWS_PER_LANGUAGE = 1200
WINDOWS_PER_DOCUMENT = 3
#: Rows that are drawn for each that is taken: draws scatter, and some texts have no letter.
SPARE = 8
EPOCHS = 8
LEAST_STEPS = 300
BATCH = 128
RATE = 0.01
#: Windows that are scored at once.
AT_ONCE = 4096
UNDETERMINED = "und"


def cut(raw: np.ndarray) -> np.ndarray:
    """The windows of one text's bytes, padded with blanks."""
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, 0x20, np.uint8)
    out[: len(raw)] = LOWER[raw]
    return out.reshape(n, WINDOW)


class Network:
    """tables[w][j]: what byte values add to the filters of width w at place j. out, bias: the softmax layer."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [[rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        weights = [t for row in self.tables for t in row] + [self.out, self.bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        share = np.bincount(y, minlength=len(self.labels)) / len(y)
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(x)))):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                for w, grad, m, v in zip(weights, self._gradients(x[at], y[at], 1 / (len(self.labels) * np.maximum(share[y[at]], 1e-9))), first, second):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, rows, pools, places = len(x), np.arange(len(x))[:, None], [], []
        for tables, width in zip(self.tables, WIDTHS):
            total = sum(t[x[:, j : WINDOW - width + 1 + j]] for j, t in enumerate(tables))
            places.append(total.argmax(1))
            pools.append(np.take_along_axis(total, places[-1][:, None], 1)[:, 0])
        pool = np.concatenate(pools, 1)
        p = softmax(pool @ self.out + self.bias)
        p[np.arange(n), y] -= 1
        p *= (weight / n)[:, None].astype(np.float32)
        back, grads = p @ self.out.T, []
        for k, (tables, place) in enumerate(zip(self.tables, places)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j, t in enumerate(tables):
                grad = np.zeros_like(t)
                np.add.at(grad, (x[rows, place + j], np.broadcast_to(np.arange(FILTERS), place.shape)), part)
                grads.append(grad)
        return [*grads, pool.T @ p, p.sum(0)]

    def prepare(self) -> None:
        """Tables by pairs of bytes, which halve the lookups."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        (a0, a1), (b0, b1, self.third), (c0, c1, c2, c3) = self.tables
        self.pairs = np.concatenate([pair(a0, a1), pair(b0, b1), pair(c0, c1)], 1)
        self.last = pair(c2, c3)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probabilities of each window."""
        by_place = np.ascontiguousarray(x.T)
        pair = by_place[:-1].astype(np.int32) * 256 + by_place[1:]
        best = np.full((len(x), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        for p in range(WINDOW - 1):
            now = self.pairs[pair[p]]
            if p + 2 < WINDOW:
                now[:, FILTERS : 2 * FILTERS] += self.third[by_place[p + 2]]
            if p + 3 < WINDOW:
                now[:, 2 * FILTERS :] += self.last[pair[p + 2]]
            used = (1 + (p + 2 < WINDOW) + (p + 3 < WINDOW)) * FILTERS
            np.maximum(best[:, :used], now[:, :used], out=best[:, :used])
        return softmax(best @ self.out + self.bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def drawn_windows(docs: DataFrame) -> DataFrame:
    """lang, windows (joined) of the rows that the network learns from, at most `most` a label: where a text lies its windows are cut, so no text moves.

    Rows are drawn by a hash of doc_id and text against a threshold for their label. The thresholds come from the labels' counts, one
    row a label, as many as the network has outputs. Rows with the same doc_id and text are drawn once.
    """
    most = WINDOWS_PER_LANGUAGE // WINDOWS_PER_DOCUMENT
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter(F.coalesce(remainder(F.col("doc_id")) != 1, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r.lang: SPARE * most / r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    threshold = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")] if share else F.lit(0.0)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.withColumn("_draw", draw).filter((F.col("_draw") < threshold) & F.col("text").rlike("\\p{L}"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(text_column(batch))
            out = []
            for row in range(batch.num_rows):
                x = cut(raw[at[row] : at[row + 1]])
                out.append(x[np.unique(np.linspace(0, len(x) - 1, WINDOWS_PER_DOCUMENT).astype(int))].tobytes())
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.binary())], names=["lang", "doc_id", "draw", "windows"])

    cuts = drawn.select("lang", "doc_id", F.col("_draw").alias("draw"), "text").mapInArrow(some, "lang string, doc_id long, draw double, windows binary").distinct()
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "windows")
    return cuts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).select("lang", "windows")


def fitted(docs: DataFrame) -> Network | None:
    """A network learnt from the rows with a label that are not held out; None without such rows."""
    rows = sorted((r.lang, bytes(r.windows)) for r in drawn_windows(docs).collect())
    if not rows:
        return None
    labels = sorted({x for x, _ in rows})
    net = Network(labels)
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    net.train(x, np.repeat([labels.index(lang) for lang, _ in rows], [len(w) // WINDOW for _, w in rows]))
    return net


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    labels = net.labels if net else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net:
            net.prepare()
        for batch in batches:
            column = text_column(batch, "text")
            letters = np.array(batch.column(3).to_pylist(), bool)
            total = np.zeros((len(letters), max(1, len(labels))))
            raw, at = text_bytes(column)
            for first, end in slices(at, AT_ONCE * WINDOW) if net else []:
                windows = [cut(raw[at[r] : at[r + 1]]) for r in range(first, end)]
                owner = np.repeat(np.arange(first, end), [len(w) for w in windows])
                x = np.concatenate(windows)
                size = np.full(len(x), WINDOW)
                n = np.diff(at[first : end + 1])
                ends = np.cumsum([len(w) for w in windows]) - 1
                size[ends[n > 0]] = n[n > 0] - (-(-n[n > 0] // WINDOW) - 1) * WINDOW
                for k in range(0, len(x), AT_ONCE):
                    np.add.at(total, owner[k : k + AT_ONCE], net.score(x[k : k + AT_ONCE]) * size[k : k + AT_ONCE, None])
            total /= np.maximum(1, np.diff(at))[:, None]
            best = total.argmax(1)
            known = letters & bool(labels)
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array([labels[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())], pa.string()), "score": pa.array(np.where(known, np.clip(total[np.arange(len(letters)), best], 0, 1), 0.0))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs, fitted(docs))
