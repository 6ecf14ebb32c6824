"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors, less their mean, are ordered by the concatenated signs of 64 random projections and every vector is
compared with at least the next WINDOW ones of that order, also across the borders of partitions. Each chunk of that order is then
sorted LOCAL times more, by projections less the chunk's own mean: a dense topic fills chunks of its own and is spread again.
What reaches the bound is verified in double precision. Rounds of passes follow until one adds no more than a thousandth of the
joins found (none, if there are fewer than a thousand), so their number grows with rows and density.

The verified pairs of all passes are united into components. A pair that links lies in one component, so all links are then
counted inside the components, in blocks of bounded size: a family larger than the window loses none of its pairs. Vectors travel as
they are stored (single or double precision) and are brought to unit length, in double precision, where they are compared.

Equal vectors are one vector with a weight and an id of its own. Edge cases: a vector that is null, zero, or holds a null or non-finite
component links with nothing; so do vectors of different lengths. Each such row is a component of its own. Rows with a null
vec_id link as others do, but a component is named after the least non-null vec_id (null where there is none), and only such a row is
kept whose vec_id is its component's. Rows that repeat a vec_id, with equal or other vectors, each count as another vector. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import Forest, components
from tessera.llm.shared import written

LEAST_COSINE = 0.95
PASSES = 16
BITS = 64
WINDOW = 128
LOCAL = 3
CHUNK = 16_384
CHUNK_BYTES = 32 << 20
SETTLED = 1000
#: Vectors of a block, and the bytes that a block of long vectors has at most; blocks are compared in tiles.
BLOCK, BLOCK_BYTES = 16_384, 16 << 20
TILE = 1024
SEED = 20240229


def kind_of(rows: DataFrame) -> str:
    """How the components of the column embedding are stored."""
    return "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def units_of(raw: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, safe from overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, key (of equal unit vectors; null if the row can't link), raw (its components' bytes)."""
    kind = kind_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for values in batch.column(1):
                x = np.zeros(0)
                if values.is_valid and not values.values.null_count:
                    x = values.values.to_numpy(zero_copy_only=False).astype(kind)
                scale = float(np.abs(x).max()) if len(x) else 0.0
                if not np.isfinite(scale) or scale == 0:
                    keys.append(None)
                    raws.append(None)
                    continue
                raws.append(x.tobytes())
                keys.append(hashlib.blake2b(units_of(x[None, :]).tobytes(), digest_size=16).digest())
            yield pa.record_batch({"vec_id": batch.column(0), "key": pa.array(keys, pa.binary()), "raw": pa.array(raws, pa.binary())})

    stored = "array<float>" if kind == "<f4" else "array<double>"
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(stored)).mapInArrow(run, "vec_id long, key binary, raw binary")


def sizes_of(column: pa.Array, kind: str) -> np.ndarray:
    return np.array([len(x) for x in column.to_pylist()], np.int64) // np.dtype(kind).itemsize


def matrix(column: pa.Array, size: int, kind: str) -> np.ndarray:
    return units_of(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size))


def centres(reps: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """The mean vector of each length that 1000 vectors or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sizes_of(batch.column(0), kind)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                total = matrix(batch.column(0).take(pa.array(at)), size, kind).sum(axis=0)
                yield pa.record_batch({"size": pa.array(np.full(size, size, np.int32)), "at": pa.array(np.arange(size, dtype=np.int32)), "total": pa.array(total), "n": pa.array(np.full(size, len(at), np.int64))})

    sums = reps.select("raw").mapInArrow(run, "size int, at int, total double, n long").groupBy("size", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out: dict[int, np.ndarray] = {}
    for row in sums.filter("n >= 1000").collect():
        out.setdefault(row["size"], np.zeros(row["size"]))[row["at"]] = row["total"] / row["n"]
    return out


def sign_codes(units: np.ndarray, seed: int | list[int], centre: np.ndarray | None = None) -> np.ndarray:
    """The signs of BITS random projections, as one unsigned number a vector."""
    towards = np.random.default_rng(seed).standard_normal((units.shape[1], BITS))
    return np.packbits(units @ towards >= (0 if centre is None else centre @ towards), axis=1).view(">u8")[:, 0].astype(np.uint64)


def coded(reps: DataFrame, passes: range, means: dict[int, np.ndarray], kind: str) -> DataFrame:
    """A row for each vector and pass: pass, size, code (its place in the pass's order), rep, raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sizes_of(batch.column(1), kind)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                units = matrix(part.column(1), int(size), kind)
                for k in passes:
                    code = sign_codes(units, SEED + k, means.get(int(size))) ^ np.uint64(1 << 63)
                    yield pa.record_batch({"pass": pa.array(np.full(len(at), k, np.int32)), "size": pa.array(np.full(len(at), size, np.int32)), "code": pa.array(code.view(np.int64)), "rep": part.column(0), "raw": part.column(1)})

    return reps.select("rep", "raw").mapInArrow(run, "pass int, size int, code long, rep long, raw binary")


def window_links(units: np.ndarray, reps: np.ndarray, window: int, least: float, forest: Forest, local: int = 0, seed: int = 0) -> list[tuple[int, int]]:
    """Verified pairs that join sets of the forest: of vectors within the window in the given order and in `local` orders of their own."""
    out: list[tuple[int, int]] = []
    short = units.astype(np.float32)
    label = np.array([forest.root(x) for x in reps.tolist()], np.int64)
    for k in range(local + 1 if len(reps) > 2 * window else 1):
        order = np.argsort(sign_codes(units, [seed, k], units.mean(axis=0)), kind="stable") if k else np.arange(len(reps))
        for first in range(0, len(order), window):
            rows, columns = order[first : first + window], order[first : first + 2 * window]
            a, b = np.nonzero(short[rows] @ short[columns].T >= least - 1e-4)
            a, b = rows[a[a < b]], columns[b[a < b]]
            apart = label[a] != label[b]
            if not apart.any():
                continue
            a, b = a[apart], b[apart]
            near = np.einsum("ij,ij->i", units[a], units[b]) >= least
            a, b = a[near], b[near]
            while len(a):
                some = np.unique(b, return_index=True)[1]
                for x, y in zip(reps[a[some]].tolist(), reps[b[some]].tolist()):
                    if forest.join(x, y):
                        out.append((x, y))
                met = np.unique(np.concatenate([a, b]))
                label[met] = [forest.root(x) for x in reps[met].tolist()]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
    return out


def neighbours(rows: DataFrame, window: int, least: float, parts: int, kind: str = "<f8") -> DataFrame:
    """Links a, b found in windows of the order: of each partition, and of each border of two, a spanning forest of its verified pairs."""

    def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = (pa.array(x, pa.int64()) for x in zip(*pairs))
        empty = pa.nulls(len(a), pa.int32())
        return pa.record_batch({"a": a, "b": b, "border": empty, "pass": empty, "size": empty, "code": pa.nulls(len(a), pa.int64()), "raw": pa.nulls(len(a), pa.binary())})

    def edge(part: pa.Table, border: int) -> Iterator[pa.RecordBatch]:
        n = part.num_rows
        yield from pa.table({"a": part["rep"], "b": pa.nulls(n, pa.int64()), "border": pa.array(np.full(n, border, np.int32)), "pass": part["pass"], "size": part["size"], "code": part["code"], "raw": part["raw"]}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, fresh, here = Forest(), None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                yield from edge(pa.Table.from_batches([batch.slice(0, window)]), here - 1)
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            fresh += batch.num_rows
            if fresh >= CHUNK or held.nbytes >= CHUNK_BYTES:
                if out := compared(held, forest, LOCAL):
                    yield links(out)
                held, fresh = held.slice(held.num_rows - min(window, held.num_rows)).combine_chunks(), 0
        if held is not None:
            if fresh and (out := compared(held, forest, LOCAL)):
                yield links(out)
            yield from edge(held.slice(held.num_rows - min(window, held.num_rows)), here)

    def compared(part: pa.Table, forest: Forest, local: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        group = part["pass"].to_numpy().astype(np.int64) << 32 | part["size"].to_numpy()
        for g in np.unique(group).tolist():
            at = pa.array(np.flatnonzero(group == g))
            out += window_links(matrix(part["raw"].take(at), g & 0xFFFFFFFF, kind), part["rep"].take(at).to_numpy(), window, least, forest, local, SEED + (g >> 32))
        return out

    def across(part: pa.Table) -> pa.Table:
        out = compared(part.rename_columns({"a": "rep"}).sort_by([("code", "ascending"), ("rep", "ascending")]), Forest(), 0)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    ordered = rows.repartitionByRange(parts, "pass", "size", "code", "rep").sortWithinPartitions("pass", "size", "code", "rep")
    found = written(ordered.mapInArrow(run, "a long, b long, border int, pass int, size int, code long, raw binary"), "neighbours")
    return found.filter("b is not null").select("a", "b").unionByName(found.filter("b is null").groupBy("border").applyInArrow(across, "a long, b long"))


def counted(members: DataFrame, least: float, block: int, kind: str) -> DataFrame:
    """rep, links (weighted vectors of the same component within the bound, itself not counted). members: root, _n (vectors of the root), rep, weight, raw."""
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(BLOCK_BYTES / F.octet_length("raw"))))
    # of one length within a root, for others don't link
    placed = members.withColumn("_blocks", F.ceil(F.col("_n") / most).cast("int")).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    paired = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    keyed = paired.select(F.xxhash64("root", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("group"), (F.col("_own") > F.col("_other")).alias("second"), (F.col("_own") == F.col("_other")).alias("alone"), "rep", "weight", "raw")

    def one(rows: pa.Table) -> pa.RecordBatch:
        reps, weight, second = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False)
        alone = rows.column(2)[0].as_py()
        size = sizes_of(rows.column(5), kind)
        links = np.zeros(len(reps), np.int64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            u, side = matrix(rows.column(5).take(pa.array(at)), n, kind), second[at]
            for first in range(0, len(at), TILE):
                tile = slice(first, first + TILE)
                near = u[tile] @ u.T >= least
                if alone:
                    near[np.arange(len(near)), np.arange(first, first + len(near))] = False
                else:
                    near &= side[tile][:, None] != side[None, :]
                links[at[tile]] += near @ weight[at]
        return pa.record_batch({"rep": pa.array(reps), "links": pa.array(links)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if held and held[0].column(0)[0].as_py() != group[a]:
                    yield one(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield one(pa.Table.from_batches(held).combine_chunks())

    counts = keyed.repartition("group").sortWithinPartitions("group").mapInArrow(run, "rep long, links long")
    return counts.groupBy("rep").agg(F.sum("links").alias("links"))


def joined(reps: DataFrame, passes: int, window: int, least: float, kind: str) -> DataFrame:
    """node, root of all links that rounds of passes find, until a round adds next to none."""
    means, n = centres(reps, kind), reps.count()
    most = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, before, known = 0, 0, None
    while True:
        more = range(done, done + (max(1, passes // 2) if done else passes))
        total = n * len(more)
        # partitions of several windows at least, so that a border has no third one in its reach
        links = neighbours(coded(reps, more, means, kind), window, least, max(1, min(total // (64 * window), max(most, total // 500_000))), kind)
        known = components(links if known is None else links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        now = known.count()  # a join each
        if n <= window or done and now - before <= now // SETTLED:
            return known
        done, before = more.stop, now


def near_duplicates(rows: DataFrame, least: float = LEAST_COSINE, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    kind = kind_of(rows)
    vectors = written(unit_vectors(rows), "vectors")
    distinct = vectors.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    # an id for each different vector: vec_ids may repeat. The table is written once, so the ids stay
    reps = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "reps")
    roots = joined(reps, passes, window, least, kind)
    rooted = written(reps.join(roots, reps["rep"] == roots["node"], "left").select("key", "rep", "least", "weight", "raw", F.coalesce("root", "rep").alias("root")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("_n")), "roots")
    links = counted(rooted.join(named.filter("_n > 1"), "root").select("root", "_n", "rep", "weight", "raw"), least, block, kind)
    known = rooted.drop("raw").join(named, "root").join(links, "rep", "left").select("key", F.lit(True).alias("usable"), "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"))
    out = vectors.select("vec_id", "key").join(written(known, "known"), "key", "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(y) FROM r WHERE r.x = vec_id), vec_id)) AS component_id,
  vec_id <= coalesce((SELECT min(y) FROM r WHERE r.x = vec_id), vec_id) AS kept
FROM v
"""
