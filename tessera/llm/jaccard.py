"""N-gram Jaccard join by a count-vector R-tree.

A document's set is its distinct five-word shingles (lower-cased A-Z), as 64-bit hashes; equal sets are one class. Two
classes link when 9 * intersection >= 4 * (sum of sizes), which is a Jaccard index of 0.8. No link is lost:

1. Linked sets share one of the first n - ceil(0.8 n) + 1 of their shingles in any common order. In hash order,
   with common shingles last, these deal the classes into groups; shingles that one class alone has drop out.
2. In each group shingle hashes are counted by slots, more for longer texts. These count vectors, folded to GROUPS slots, are the points of an R-tree; summed coordinate minima
   bound the overlap from above, and the unfolded ones bound what survives. The rest is kept as a forest, not as pairs.
3. Connected candidates meet in blocks with their whole sets; survivors of the bound are verified exactly
   unless a chain of links joins them already, and links are kept as a forest again.

Hot groups, and candidates that fill several blocks, are dealt to parts by hash, and a few pivots go to all parts: a family of near
copies is one component after each part has been settled by itself. Only what is not of a group's largest component then
visits the other parts, in parts of its own, so every pair that a chain doesn't join yet still meets, and a family costs no pairs of parts.
Copies send one row a task. Common shingles, of passages that many documents hold, come last in the order, so a passage makes no group of all
its documents, which would grow with the square of the corpus. They only set the order; there are MOST_COMMON of them at most.

Edge cases: a null text and one without words have the empty set, link with nothing and are their own component. Rows with one
doc_id stay rows; their component is that of their own text. A null doc_id has the least id of its component, or null.
An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import Forest, components
from tessera.llm.repeats import keyed, packed
from tessera.llm.shared import few_rows, give_back, sheltered, slices, text_bytes, text_column, written
from tessera.llm.wordhash import SLICE, windows, word_hashes, word_spans

WORDS = 5
GROUP_BITS = 6
GROUPS = 1 << GROUP_BITS
#: Shingles a slot on average, at most: with more, the vectors of long texts are all alike.
DENSE = 8
LEAF = 16
#: Rows of a part of a hot group (one of more than twice as many), and shingles of a block.
PART, BLOCK = 512, 800_000
#: A shingle is common if so many different sets have it (whatever the corpus), and it is one of the most frequent ones. It is known by so many leading bits.
COMMON_IN_BATCH, MOST_COMMON = 64, 250_000
COUNTED_BITS = 36
#: Shingles whose counts a task holds before it sends them.
COUNTED_AT_ONCE = 4_000_000
PIVOTS = 8


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, end in slices(at, SLICE):
        data, offsets = raw[at[first] : at[end]], at[first : end + 1] - at[first]
        starts, ends, by_doc = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=True)
        for a, b in zip(by_doc[:-1].tolist(), by_doc[1:].tolist()):
            x = np.sort(windows(hashes[a:b], words))
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def prefix_size(n: int) -> int:
    return n + (-4 * n // 5) + 1


def common_last(x: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first prefix_size() shingles in hash order, common ones (their leading bits) after all others."""
    n = prefix_size(len(x))
    if len(common):
        lead = x >> np.uint64(64 - COUNTED_BITS)
        late = common[np.minimum(np.searchsorted(common, lead), len(common) - 1)] == lead
        if late[:n].any():
            x = np.concatenate([x[~late], x[late]])
    return x[:n]


def class_id(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)


def count_vector(x: np.ndarray) -> np.ndarray:
    """How many shingles fall in each slot of the leading bits: GROUPS slots, twice as many for each doubling beyond DENSE a slot."""
    bits = GROUP_BITS + max(0, (len(x) - 1) // (GROUPS * DENSE)).bit_length()
    return np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u4")


def folded(vector: np.ndarray, slots: int = GROUPS) -> np.ndarray:
    return vector.reshape(slots, -1).sum(1)


def bounded(a: np.ndarray, b: np.ndarray, n: int) -> bool:
    """Whether two count vectors let sets of n shingles in all link."""
    slots = min(len(a), len(b))
    return 9 * int(np.minimum(folded(a, slots), folded(b, slots)).sum()) >= 4 * n


def counts_packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending values below 2**32 and their counts, by differences and byte planes."""
    planes = np.concatenate([np.diff(values, prepend=values[:1] * 0), counts]).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def counts_unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.uint64)
    return np.cumsum(both[: len(both) // 2], dtype=np.uint64), both[len(both) // 2 :]


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted leading COUNTED_BITS of the shingles that COMMON_IN_BATCH different sets or more have, of the MOST_COMMON most frequent.

    All shingles of all documents are counted: each task sends its counts by ranges of the hash, packed, and a range's counts meet in one task.
    Copies count once a task.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = np.uint64(COUNTED_BITS - max(4, (2 * partitions - 1).bit_length()))  # bits within a range

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(parts))
        cut = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        counts, every = np.diff(np.append(cut, len(every))), every[cut]
        ranges = every >> low
        begin = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        end = np.append(begin[1:], len(every))
        inner = every & np.uint64((1 << int(low)) - 1)
        blobs = [counts_packed(inner[a:b], counts[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
        return pa.record_batch({"key": pa.array(ranges[begin].astype(np.int64)), "counts": pa.array(blobs, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in few_rows(batches, 2500):
            raw, at = text_bytes(text_column(batch))
            for x in shingle_sets(raw, at):
                if len(x) and (rid := class_id(x)) not in seen:
                    seen.add(rid)
                    held.append(x >> np.uint64(64 - COUNTED_BITS))
                    size += len(x)
                    if size > COUNTED_AT_ONCE:
                        yield counted(held)
                        held, size = [], 0
        if held:
            yield counted(held)
        held = []
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches):
            values, counts = (np.concatenate(x) for x in zip(*(counts_unpacked(b.as_py()) for b in table.column(1))))
            order = np.argsort(values, kind="stable")
            values = values[order]
            cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            n = np.add.reduceat(counts[order], cut)
            often = np.flatnonzero(n >= COMMON_IN_BATCH)
            if len(often):
                h = (np.uint64(table.column(0)[0].as_py()) << low) + values[cut[often]]
                yield pa.record_batch({"h": pa.array(h.astype(np.int64)), "n": pa.array(n[often].astype(np.int64))})
        give_back()

    sent = docs.select("text").mapInArrow(count, "key long, counts binary")
    found = written(sent.repartition("key").sortWithinPartitions("key").mapInArrow(add, "h long, n long"), "common")
    rows = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.uint64))


def described(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, _doc, _tag, n, rid (class), and of the first row of a class in a task: vector, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in few_rows(batches, 2500):
            raw, at = text_bytes(text_column(batch))
            n, rid, vector, prefix = [], [], [], []
            for x in shingle_sets(raw, at):
                n.append(len(x))
                rid.append(class_id(x) if len(x) else None)
                new = len(x) and rid[-1] not in seen
                seen.add(rid[-1])
                vector.append(count_vector(x).tobytes() if new else None)
                prefix.append(common_last(x, common).tobytes() if new else None)
            yield pa.record_batch([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(rid, pa.int64()), pa.array(vector, pa.binary()), pa.array(prefix, pa.binary())], names=["doc_id", "_doc", "_tag", "n", "rid", "vector", "prefix"])

    rows = keyed(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "_doc", "_tag", "text")
    return rows.mapInArrow(run, "doc_id long, _doc long, _tag long, n long, rid long, vector binary, prefix binary")


def prefix_tokens(rows: DataFrame) -> DataFrame:
    """token, rid of each class's prefix shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                size = np.array([len(x) // 8 for x in part.column(1).to_pylist()])
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64)
                yield pa.record_batch({"token": pa.array(tokens), "rid": pa.array(np.repeat(part.column(0).to_numpy(), size))})

    return rows.select("rid", "prefix").mapInArrow(run, "token long, rid long")


def group_lists(members: DataFrame) -> DataFrame:
    """group, visitors, rids: for each key the classes to compare, the same list of classes once. members: key, visits, rid.

    Of rids the first `visitors` are compared with all, the others only with these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        seen: set[bytes] = set()

        def settle(key: np.ndarray, home: np.ndarray, rid: np.ndarray) -> pa.RecordBatch | None:
            other = np.ones(len(key), bool)
            other[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1]) | (rid[1:] != rid[:-1])
            key, home, rid = key[other], home[other], rid[other]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            out = []
            for k in np.flatnonzero(np.diff(cut) > 1).tolist():
                part, visitors = rid[cut[k] : cut[k + 1]], int(np.count_nonzero(~home[cut[k] : cut[k + 1]]))
                mark = hashlib.blake2b(part.tobytes() + b"%d" % visitors, digest_size=8).digest()
                if visitors and mark not in seen:
                    seen.add(mark)
                    out.append((int.from_bytes(mark, "little", signed=True), visitors, part))
            if len(seen) > 100_000:
                seen.clear()
            return pa.record_batch({"group": pa.array([g for g, _, _ in out], pa.int64()), "visitors": pa.array([v for _, v, _ in out], pa.int32()), "rids": pa.array([p for _, _, p in out], pa.list_(pa.int64()))}) if out else None

        for batch in batches:
            arrays = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            last = np.searchsorted(arrays[0], arrays[0][-1]) if len(arrays[0]) else 0
            held = [a[last:] for a in arrays]
            if last and (out := settle(*(a[:last] for a in arrays))) is not None:
                yield out
        if len(held[0]) and (out := settle(*held)) is not None:
            yield out

    rows = members.select("key", (~F.col("visits")).alias("home"), "rid")
    return rows.repartition("key").sortWithinPartitions("key", "home", "rid").mapInArrow(run, "group long, visitors int, rids array<long>").dropDuplicates(["group"])


def part_of(rid: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(rid), F.col(parts)).cast("int")


def every_part(parts: str) -> Column:
    return F.sequence(F.lit(0), F.col(parts) - 1)


def to_parts(rows: DataFrame, of: str, members: str, parts: str) -> DataFrame:
    """rows with _part: each in its own part of its `of`, pivots in all. members, parts: how many `of` has."""
    pivot = F.pmod(F.xxhash64("rid", F.lit(7)), F.ceil(F.col(members) / PIVOTS)) == 0
    return rows.withColumn("_part", F.explode(F.when(pivot & (F.col(parts) > 1), every_part(parts)).otherwise(F.array(part_of("rid", parts)))))


def visits(rows: DataFrame, of: str, weight: Column, most: int) -> DataFrame | None:
    """The pairs of parts that are still to meet after each part was settled by itself, or None. rows: `of`, rid, _parts, _root (of the components so far) and what else is to be kept.

    Who is not of the largest component of its `of` is a visitor, in parts of at most `most` by weight; a key is a part at home and one of
    visitors: key, visits, and the columns of rows.
    """
    sizes = rows.groupBy(of, "_root").agg(F.count("*").alias("_c"))
    largest = written(sizes.groupBy(of).agg(F.max_by("_root", F.struct("_c", "_root")).alias("_main"), F.count("*").alias("_roots")).filter("_roots > 1").drop("_roots"), "largest")
    if largest.isEmpty():
        return None
    split = rows.join(largest, of)
    guests = written(split.filter("_root <> _main").groupBy(of).agg(F.ceil(F.sum(weight) / most).cast("int").alias("_guests")), "guests")
    split = written(split.join(guests, of), "split")
    coming = split.filter("_root <> _main").withColumns({"_there": part_of("rid", "_guests"), "_part": F.explode(every_part("_parts")), "visits": F.lit(True)})
    home = split.withColumns({"_part": part_of("rid", "_parts"), "_there": F.explode(every_part("_guests")), "visits": F.lit(False)})
    return coming.unionByName(home).withColumn("key", F.xxhash64(of, "_part", "_there")).drop("_part", "_there", "_main", "_guests")


class CountTree:
    """An R-tree over count vectors, bulk-loaded by size. Nodes hold their points' coordinate maxima and least and largest sizes."""

    def __init__(self, n: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        self.n, self.points = n[self.order].astype(np.int64), vectors[self.order].astype(np.int32)
        self.levels = []  # from the leaves up: (maxima, least sizes, largest sizes)
        maxima, least, largest = self.points, self.n, self.n
        while len(maxima) > LEAF:
            cut = np.arange(0, len(maxima), LEAF)
            maxima, least, largest = np.maximum.reduceat(maxima, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(largest, cut)
            self.levels.append((maxima, least, largest))

    @staticmethod
    def _open(n: int, vector: np.ndarray, maxima: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
        near = (5 * largest >= 4 * n) & (4 * least <= 5 * n)
        at = np.flatnonzero(near)
        bound = np.minimum(maxima[at], vector).sum(1)
        return at[9 * bound >= 4 * (n + least[at])]

    def near(self, n: int, vector: np.ndarray) -> np.ndarray:
        """Numbers of the points whose bound lets them link with this one."""
        vector, at = vector.astype(np.int32), None
        for maxima, least, largest in reversed(self.levels):
            at = np.arange(len(maxima)) if at is None else at[at < len(maxima)]
            at = at[self._open(n, vector, maxima[at], least[at], largest[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = np.arange(len(self.n)) if at is None else at[at < len(self.n)]
        return self.order[at[self._open(n, vector, self.points[at], self.n[at], self.n[at])]]


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first column, by which they are ordered."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if held and held[0].column(0)[0].as_py() != key[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def joined_by(roots: list, forest: Forest) -> None:
    """Unites the rows (numbers in a list) that have one root."""
    first: dict = {}
    for k, root in enumerate(roots):
        if first.setdefault(root, k) != k:
            forest.join(first[root], k)


def candidates(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Forests a, b of the classes that the R-tree's bound lets link in a group. classes: rid, n, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in runs_of(batches):
            home, rids, n = table.column(1).to_pylist(), table.column(2).to_pylist(), np.asarray(table.column(3))
            fine = [np.frombuffer(v, "<u4") for v in table.column(4).to_pylist()]
            if len(rids) == 2:
                if 5 * n.min() >= 4 * n.max() and bounded(fine[0], fine[1], int(n.sum())):
                    out.append((rids[0], rids[1]))
            else:
                vectors = np.stack([folded(v) for v in fine])
                tree, forest = CountTree(n, vectors), Forest()
                joined_by(rids, forest)  # who visits his own part is there twice
                apart = len({forest.root(k) for k in range(len(rids))})
                for k in range(len(rids)):
                    if home[k]:
                        continue
                    if apart == 1:
                        break
                    links = [(rids[k], rids[j]) for j in tree.near(int(n[k]), vectors[k]).tolist() if forest.root(j) != forest.root(k) and bounded(fine[k], fine[j], int(n[k] + n[j])) and forest.join(k, j)]
                    apart -= len(links)
                    out += links
            if len(out) > 20_000:
                yield links_batch(out)
                out = []
        if out:
            yield links_batch(out)

    rows = groups.select("group", "visitors", F.posexplode("rids").alias("_at", "rid")).join(classes, "rid").select("group", (F.col("_at") >= F.col("visitors")).alias("home"), "rid", "n", "vector")
    return rows.repartition("group").sortWithinPartitions("group", "home", "rid").mapInArrow(run, "a long, b long")


def as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with _root, their rid's root so far."""
    return rows.join(roots.select(F.col("node").alias("rid"), F.col("root").alias("_r")), "rid", "left").withColumn("_root", F.coalesce("_r", "rid")).drop("_r")


def candidate_roots(firsts: DataFrame) -> DataFrame:
    """node, root of the classes that chains of the R-tree's bound connect. firsts: rid, n, vector, prefix, a row a class."""
    tokens, classes = prefix_tokens(firsts), firsts.select("rid", "n", "vector")
    counts = tokens.groupBy("token").agg(F.count("*").alias("_c")).filter(F.col("_c") > 2 * PART)
    hot = written(counts.select("token", "_c", F.ceil(F.col("_c") / PART).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        groups = group_lists(tokens.select(F.col("token").alias("key"), F.lit(True).alias("visits"), "rid"))
        return components(candidates(groups, classes))
    split = tokens.join(hot, "token", "left").withColumns({"_c": F.coalesce("_c", F.lit(1)), "_parts": F.coalesce("_parts", F.lit(1))})
    keyed_by_part = to_parts(split, "token", "_c", "_parts").select(F.when(F.col("_parts") == 1, F.col("token")).otherwise(F.xxhash64("token", "_part")).alias("key"), F.lit(True).alias("visits"), "rid")
    roots = components(candidates(group_lists(keyed_by_part), classes))
    more = visits(with_roots(tokens.join(hot.drop("_c"), "token"), roots), "token", F.lit(1), PART)
    return roots if more is None else components(candidates(group_lists(more), classes).unionByName(as_links(roots)))


def verified(members: DataFrame) -> DataFrame:
    """Forests a, b of links between the classes that meet under a key. members: key, visits, rid, _root (of the links so far), _packed (a text of the class).

    The compressed texts travel, which are smaller than their sets; a key's task makes the sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for table in runs_of(batches):
            home, every = table.column(1).to_pylist(), np.asarray(table.column(2))
            rows = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]) | (np.diff(home) != 0)]))  # rows that are the same in all come together
            rids, home, roots = every[rows].tolist(), [home[r] for r in rows.tolist()], np.asarray(table.column(3))[rows].tolist()
            raw, at = text_bytes(pa.array([unpacker.decompress(x.as_py()).decode() for x in table.column(4).take(pa.array(rows))], pa.large_string()))
            sets = list(shingle_sets(raw, at))
            n = np.array([len(x) for x in sets])
            vectors = np.stack([folded(count_vector(x)) for x in sets])
            begin = np.cumsum(n) - n
            distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
            tree, forest, mark, out = CountTree(n, vectors), Forest(), np.zeros(len(distinct), bool), []
            joined_by(roots, forest)
            apart = len({forest.root(k) for k in range(len(rids))})
            del sets, raw
            for k in range(len(rids)):
                if home[k]:
                    continue
                if apart == 1:
                    break
                root = forest.root(k)
                near = [j for j in tree.near(int(n[k]), vectors[k]).tolist() if forest.root(j) != root]
                if not near:
                    continue
                own = codes[begin[k] : begin[k] + n[k]]
                mark[own] = True
                for j in near:
                    if forest.root(j) != forest.root(k) and 9 * int(np.count_nonzero(mark[codes[begin[j] : begin[j] + n[j]]])) >= 4 * int(n[k] + n[j]):
                        forest.join(k, j)
                        apart -= 1
                        out.append((rids[k], rids[j]))
                mark[own] = False
            if out:
                yield links_batch(out)
        give_back()

    rows = members.select("key", (~F.col("visits")).alias("home"), "rid", "_root", "_packed")
    return rows.repartition("key").sortWithinPartitions("key", "home", "rid").mapInArrow(run, "a long, b long")


def linked_roots(wanted: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, root of the classes that chains of links connect. wanted: root (of the candidates), rid, n, and _doc, _tag of a document of the class."""
    sizes = written(wanted.groupBy("root").agg(F.count("*").alias("_n"), F.ceil(F.sum("n") / block).cast("int").alias("_parts")).filter("_n > 1"), "sizes")
    placed = wanted.join(sizes, "root")
    texts = packed(docs.select("doc_id", "text")).groupBy("_doc", "_tag").agg(F.first("_packed").alias("_packed"))

    def meet(members: DataFrame) -> DataFrame:
        return verified(members.join(texts, ["_doc", "_tag"]).select("key", "visits", "rid", "_root", "_packed"))

    first = to_parts(placed, "root", "_n", "_parts").select(F.xxhash64("root", "_part").alias("key"), F.lit(True).alias("visits"), "rid", F.col("rid").alias("_root"), "_doc", "_tag")
    roots = components(meet(first))
    large = placed.filter("_parts > 1")
    if sizes.filter("_parts > 1").isEmpty():
        return roots
    more = visits(with_roots(large, roots), "root", F.col("n"), block)
    return roots if more is None else components(meet(more).unionByName(as_links(roots)))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, and _doc, _tag (its key)."""
    rows = written(described(docs, common_shingles(docs)), "classes")
    firsts = written(rows.filter("vector is not null").select("rid", "n", "vector", "prefix", "_doc", "_tag").dropDuplicates(["rid"]), "firsts")
    maybe = candidate_roots(firsts)
    rooted = maybe.select(F.col("node").alias("rid"), "root").unionByName(maybe.select(F.col("root").alias("rid"), "root").distinct())
    linked = linked_roots(written(firsts.select("rid", "n", "_doc", "_tag").join(rooted, "rid"), "wanted"), docs, block)
    joined = rows.select("doc_id", "_doc", "_tag", "n", "rid").join(linked.withColumnRenamed("node", "rid"), "rid", "left").withColumn("_class", F.coalesce("root", "rid"))
    joined = written(joined.select("doc_id", "_doc", "_tag", "n", "_class"), "joined")
    least = written(joined.filter("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("component_id")), "least")
    return joined.join(least, "_class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "_doc", "_tag")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents without those that another of their component stands for (the one with the least doc_id); the columns of docs."""
    rows, restored = sheltered(docs, "doc_id", "text")
    found = near_duplicates(docs)
    kept = found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select("_doc", "_tag").distinct()
    return restored(keyed(rows).join(kept, ["_doc", "_tag"], "left_semi").dropDuplicates(["_doc", "_tag"]))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_doc", "_tag")


_W = r"'[^\x20\x09-\x0D]+'"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.y, n.doc_id)) AS component_id FROM n LEFT JOIN m ON n.doc_id = m.x
"""
