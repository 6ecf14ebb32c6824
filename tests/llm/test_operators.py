"""Each operator against brute force on small tables with nulls, empty and long texts, repeated rows and extra columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, jaccard, language, mixing, packing, quality, rans, repeats, tokens, unigram, warc
from tessera.llm.components import Forest, components
from tessera.llm.wordhash import word_hashes, word_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, n int, part string, rid string"
WORDS = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(0, 4000, 10)]


def texts(seed=0, n=40):
    """Prose, near and exact copies, shared passages, odd texts."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 4, 5, 8, 60, 120, 200]))) for _ in range(n)]
    passage = " ".join(rng.choice(WORDS) for _ in range(80))
    out = [*base, *base[:6], *(b + " tail" for b in base[6:14]), *(passage + " " + b for b in base[14:20]), passage, passage + "!"]
    for b in base[20:28]:
        words = b.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return [*out, None, "", " \n\t ", "one", "ONE", "é" * 300, "é" * 300, "ab" * 400, "x\x00y \x1c z", "漢字 " * 90, "long " * 30_000, "line\nline\nline\n other"]


def documents(spark, values=None, ids=None):
    values = texts() if values is None else values
    rows = [(ids[i] if ids else i, t, "en", [None, "a", "b"][i % 3], None, "x", 1, "y", "z") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return documents(spark, [])


# components


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    forest = Forest()
    for a, b in links:
        forest.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    for x in {x for link in links for x in link}:
        assert got.get(x, x) == forest.root(x)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# words


def test_words_never_cross_documents():
    values = ["ab cd", "ef", "", " x\ty ", "A-Z\x0b\x0c1"]
    column = pa.array(values, pa.large_string())
    from tessera.llm.shared import text_bytes

    data, at = text_bytes(column)
    starts, ends, by_doc = word_spans(data, at)
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(by_doc[:-1], by_doc[1:])]
    assert got == [["ab", "cd"], ["ef"], [], ["x", "y"], ["A-Z", "1"]]
    assert len(set(word_hashes(data, starts, ends, True).tolist())) == 7


# op1


def test_language(spark):
    rng = random.Random(1)
    letters = {"xx": "abcde", "yy": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(60)), k) for i in range(120) for k in [["xx", "yy"][i % 2]]]
    docs = spark.createDataFrame([*rows, (500, None, "xx"), (501, "12 34 !", None), (502, "", "yy"), (503, "a", None), (None, "vwxyz " * 2000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predicted(docs, language.fitted(docs)).collect()}
    assert len(got) == 125 and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None) and not got[None].held_out
    held = [(got[i].lang_pred, k) for i, _, k in rows if got[i].held_out]
    assert held and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert got[None].lang_pred == "yy"
    assert language.fitted(docs.limit(0)) is None and {r.lang_pred for r in language.predicted(docs, None).collect()} == {"und"}


def test_scores_by_pairs_equal_plain_filters():
    net = language.Network(["a", "b"])
    net.prepare()
    x = np.random.default_rng(0).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    pools = []
    for tables, width in zip(net.tables, language.WIDTHS):
        pools.append(sum(t[x[:, j : language.WINDOW - width + 1 + j]] for j, t in enumerate(tables)).max(1))
    assert np.allclose(net.score(x), language.softmax(np.concatenate(pools, 1) @ net.out + net.bias), atol=1e-5)


def test_gradients_equal_small_differences():
    """The gradient of every kind of weight against the loss of plain loops."""
    rng = np.random.default_rng(4)
    net = language.Network(["a", "b", "c"])
    x, y, weight = rng.integers(97, 105, (3, language.WINDOW)).astype(np.uint8), np.array([0, 2, 1]), np.array([1.0, 0.5, 2.0])
    weights = [t for row in net.tables for t in row] + [net.out, net.bias]
    for k, w in enumerate(weights):  # in double precision
        weights[k] = w.astype(np.float64)
    at = 0
    for row in net.tables:
        for j in range(len(row)):
            row[j] = weights[at]
            at += 1
    net.out, net.bias = weights[-2:]

    def loss():
        total = 0.0
        for row in range(3):
            pools = []
            for tables, width in zip(net.tables, language.WIDTHS):
                for f in range(language.FILTERS):
                    pools.append(max(sum(tables[j][x[row, p + j], f] for j in range(width)) for p in range(language.WINDOW - width + 1)))
            z = [sum(v * net.out[i, c] for i, v in enumerate(pools)) + net.bias[c] for c in range(3)]
            total -= weight[row] / 3 * (z[y[row]] - np.log(sum(np.exp(v) for v in z)))
        return total

    grads = net._gradients(x, y, weight)
    for w, grad in zip(weights, grads):
        flat = np.flatnonzero(np.abs(grad).ravel() > 1e-4)
        for i in flat[:: max(1, len(flat) // 2)][:2]:
            place = np.unravel_index(i, w.shape)
            old, w[place] = w[place], w[place] + 1e-6
            up = loss()
            w[place] = old - 1e-6
            down = loss()
            w[place] = old
            assert (up - down) / 2e-6 == pytest.approx(grad[place], rel=1e-3, abs=1e-6)


def test_language_of_a_query_by_plain_loops(spark):
    """What the query draws, learns from and votes: by loops over rows, windows and places."""
    rng = random.Random(12)
    letters = {"xx": "abcdefg", "yy": "efghijk", "zz": "hijklmn"}
    prose = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n))
    rows = [(i, prose(k, rng.choice([4, 60, 300])), k, "clash", 1.0) for i in range(90) for k in [["xx", "yy", "zz"][i % 3]]]
    rows += [(200, prose("xx", 5) + " " + prose("yy", 400), None, "c", 1.0), (201, "é" * 3000, "xx", "c", 1.0), (7, rows[7][1], rows[7][2], "c", 1.0), (None, prose("zz", 50), "zz", "c", 1.0), (None, prose("zz", 50), "zz", "c", 1.0), (203, "1 2 3", "yy", "c", 1.0), (204, "", "yy", "c", 1.0), (205, None, "yy", "c", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    usable = {(i, t, k) for i, t, k, *_ in rows if (i is None or zlib.crc32(str(i).encode()) % 3 != 1) and k and t and any(map(str.isalpha, t))}
    drawn = sorted((r.lang, bytes(r.windows)) for r in language.drawn_windows(docs).collect())

    def windows(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        return [raw[p : p + language.WINDOW].ljust(language.WINDOW) for p in range(0, len(raw), language.WINDOW)]

    want = []
    for _, t, k in usable:
        all_ = windows(t)
        want.append((k, b"".join(all_[j] for j in sorted({int(v) for v in np.linspace(0, len(all_) - 1, language.WINDOWS_PER_DOCUMENT)}))))
    assert drawn == sorted(want)
    net = language.fitted(docs)
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 4)) for r in language.predicted(docs, net).collect()), key=repr)
    expected = []
    for i, t, *_ in rows:
        if not t or not any(map(str.isalpha, t)):
            expected.append((i, "und", 0.0))
            continue
        votes, size = np.zeros(3), len(t.encode())
        for n, w in enumerate(windows(t)):
            pools = []
            for tables, width in zip(net.tables, language.WIDTHS):
                at = np.frombuffer(w, np.uint8)
                pools.append(np.max([sum(tables[j][at[p + j]] for j in range(width)) for p in range(language.WINDOW - width + 1)], axis=0))
            z = np.concatenate(pools) @ net.out + net.bias
            votes += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * min(language.WINDOW, size - n * language.WINDOW)
        expected.append((i, net.labels[int(votes.argmax())], round(float(votes.max() / size), 4)))
    expected = sorted(expected, key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    assert np.allclose([x[2] for x in got], [x[2] for x in expected], atol=2e-3)


# op2


def brute_links(rows):
    """Of each row: its links and the least id of its component, by all pairs of rows."""
    units = []
    for _, v in rows:
        x = np.array([np.nan if y is None else y for y in v or []])
        good = len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
        x = x / np.abs(x).max() if good else x
        units.append(x / np.linalg.norm(x) if good else None)
    forest, links = Forest(), []
    for i, u in enumerate(units):
        links.append([j for j, w in enumerate(units) if j != i and u is not None and w is not None and len(u) == len(w) and u @ w >= 0.95])
        for j in links[i]:
            forest.join(i, j)
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[forest.root(i)] = min(vec_id, least.get(forest.root(i), vec_id))
    return [(vec_id, len(links[i]), least.get(forest.root(i)) if units[i] is not None else vec_id) for i, (vec_id, _) in enumerate(rows)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, kind, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8)
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for size in (1, 1, 1, 2, 3, 40, 150):
        center = rng.normal(size=16)
        for _ in range(size):
            rows.append((n, (center + rng.normal(size=16) * 0.12).astype("f4").astype(float).tolist()))
            n += 1
    rows += [(n, rows[5][1]), (n + 1, rows[5][1]), (n + 2, None), (n + 3, [0.0] * 16), (n + 4, [float("nan")] * 16), (n + 5, [None] * 16), (n + 6, []), (n + 7, [1.0, 2.0]), (n + 8, [1e30] * 16), (n + 9, [2e-30] * 16), (n + 10, [float("inf")] + [0.0] * 15)]
    # ids that repeat with other vectors, and null ids: linked with others, among themselves, and alone
    rows += [(0, rows[50][1]), (0, rows[100][1]), (0, rows[0][1]), (7, [1.0, 2.0]), (None, rows[60][1]), (None, [0.0, 3.0, 4.0]), (None, [0.0, 3.0, 4.0]), (None, None)]
    # columns whose names clash with the operator's own
    frame = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, key string, rep int, unit double").repartition(4)
    found = embeddings.near_duplicates(frame, block=32).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr)
    want = brute_links(rows)
    assert sum(n for _, n, _ in want) > 20_000 and got == sorted(want, key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_one_vector_a_partition(spark):
    x = np.random.default_rng(2).normal(size=(12, 8))
    rows = [(i, (x[i // 2] + 0.001 * i).tolist()) for i in range(24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(24, "vec_id")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect())
    assert got == sorted(brute_links(rows))


def test_pairs_in_a_dense_topic_are_found(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, planted = 20_000, 500
    x = unit(np.sqrt(0.8) * unit(rng.normal(size=(1, 64))) + np.sqrt(0.2) * unit(rng.normal(size=(n, 64))))
    a = np.arange(planted) * 2
    aside = rng.normal(size=(planted, 64))
    aside = unit(aside - (aside * x[a]).sum(1, keepdims=True) * x[a])
    x[a + 1] = 0.955 * x[a] + np.sqrt(1 - 0.955**2) * aside
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x), pa.list_(pa.float64()))})).repartition(4)
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(frame).filter(f"vec_id < {2 * planted}").collect()}
    assert sum(got[i] == got[i + 1] for i in a.tolist()) >= 0.99 * planted


def test_windows_cross_borders(spark):
    x = np.random.default_rng(9).normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(0, 8, i, i, x[i // 2].tobytes()) for i in range(800)]
    frame = spark.createDataFrame(rows, "pass int, size int, code long, rep long, raw binary")
    links = embeddings.neighbours(frame, 8, 0.999, 7).collect()
    assert {(min(r), max(r)) for r in links} == {(i, i + 1) for i in range(0, 800, 2)}


# op3


def brute_repeats(values, length):
    raw = [(t or "").encode() for t in values]
    seen = {}
    for t in raw:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in raw:
        covered = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = 1
        kept = bytes(np.frombuffer(t, np.uint8)[covered[:-1] == 0])
        out.append((len(t), int(covered.sum()), int((np.diff(np.concatenate([[0], covered])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("more", [{}, {"bucket": 2000}, {"bucket": 450}])
def test_repeats(spark, more):
    rng = random.Random(11)
    # an anchor with many different surroundings: a passage that is shorter than a string
    passage = " ".join(rng.choice(WORDS) for _ in range(45))
    around = ["".join(rng.choice("abcdef ") for _ in range(150)) for _ in range(12)]
    values = [t for t in texts(1) if t is None or len(t) < 20_000] + [a + passage + b for a in around[:6] for b in around[6:]]
    want = brute_repeats(values, 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut(documents(spark, values).select("doc_id", "text"), with_text=False, **more).collect()}
    assert [got[i] for i in range(len(values))] == want


def test_all_marks_come_from_the_index(spark, monkeypatch):
    """Copies, shared passages and repeated strings alike: without the index nothing is marked."""
    values = [t for t in texts(1) if t is None or len(t) < 20_000]
    docs = documents(spark, values).select("doc_id", "text")
    assert sum(r.n_removed for r in repeats.cut(docs, with_text=False).collect()) == sum(n for _, n, _, _ in brute_repeats(values, 200)) > 0
    monkeypatch.setattr(repeats, "bucket_marks", lambda contexts, length, bucket: spark.createDataFrame([], repeats.MARKS))
    assert {r.n_removed for r in repeats.cut(docs, with_text=False).collect()} == {0}


def test_weights_are_copies():
    """The transform of contexts with weights is that of all copies: run lengths and matches."""
    parts, weights = [b"banana", b"bandana", b"nabab"], [1, 3, 1]
    flags = repeats.repeated_starts(parts, weights, 3)
    every = [p for p, n in zip(parts, weights) for _ in range(n)]
    for p, got in zip(parts, flags):
        assert got.tolist() == [sum(q[j : j + 3] == p[i : i + 3] for q in every for j in range(len(q) - 2)) > 1 for i in range(len(p) - 2)]
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int32)
    index = repeats.RunIndex(symbols, np.repeat(weights, [7, 8, 6]))
    assert index.run_lengths.sum() == sum((len(p) + 1) * n for p, n in zip(parts, weights))


def test_a_very_long_text(spark):
    """Longer than one call of anchors() takes."""
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 9 * repeats.PART + 700_000).astype(np.uint8)).decode()
    cut = [(5_000, 5_300), (repeats.PART - 150, repeats.PART + 250), (len(long) - 200, len(long))]
    docs = spark.createDataFrame([(0, long), *((1 + i, "ä" * 50 + long[a:b] + "ö") for i, (a, b) in enumerate(cut)), (9, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.cut(docs, with_text=False).collect()}
    assert got == {0: (900, 3), 1: (300, 1), 2: (400, 1), 3: (200, 1), 9: (0, 0)}


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(WORDS[:100])
    docs = documents(spark, [text] * 40 + ["z" * 100], [None] * 20 + [3] * 20 + [4])
    assert sorted((r.doc_id or 0, r.n_removed) for r in repeats.cut(docs.select("doc_id", "text"), with_text=False).collect()) == [(0, len(text))] * 20 + [(3, len(text))] * 20 + [(4, 0)]


def test_repeats_with_text_and_shared_ids(spark):
    values = ["é" * 250 + "a", "é" * 250 + "b", "x" * 199, None, "q" * 200 + "r"]
    docs = documents(spark, values, [7, 7, 7, None, 7])
    rows = repeats.deduplicated(docs)
    assert rows.columns == docs.columns
    assert sorted((r.text, r.n_chars, r._doc) for r in rows.collect()) == sorted([("a", 1, "x"), ("b", 1, "x"), ("x" * 199, 199, "x"), ("", 0, "x"), ("q" * 200 + "r", 201, "x")])
    assert repeats.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_run_index(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(3, 30))
    parts = [bytes(rng.integers(97, 100, int(rng.integers(length, 60))).astype(np.uint8)) for _ in range(6)]
    # pieces of others in surroundings of their own, and parts that begin and end alike
    parts += [parts[k][a:] + parts[k + 1][: length // 2] + parts[k][:a] for k, a in enumerate(rng.integers(0, length, 5).tolist())]
    parts = list(dict.fromkeys(p for p in parts if len(p) >= length))
    count = {}
    for p in parts:
        for i in range(len(p) - length + 1):
            count[p[i : i + length]] = count.get(p[i : i + length], 0) + 1
    for p, flags in zip(parts, repeats.repeated_starts(parts, [1] * len(parts), length)):
        assert flags.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]
    index = repeats.RunIndex(np.frombuffer(b"\0".join(parts), np.uint8).astype(np.int32))
    assert index.run_lengths.sum() == index.n and len(index.heads) == len(index.run_symbols)


def test_anchors_of_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 3000)
    monkeypatch.setattr(repeats, "CHUNK", 2000)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdef ") for _ in range(12_000))
    values = [long, long[4000:7000], "".join(rng.choice("abc") for _ in range(500))]
    data = np.frombuffer(long.encode(), np.uint8)
    _, row, start, count, *_ = repeats.anchors(data, np.array([0, len(data)]), 200, 32)
    assert count.sum() == len(data) - 199 and start[0] == 0
    got = {r.doc_id: r.n_removed for r in repeats.cut(documents(spark, values).select("doc_id", "text"), with_text=False).collect()}
    assert got == {0: 3000, 1: 3000, 2: 0}


# op4


def test_warc(spark):
    rows = [(1, "http://B.example:80/x?q=1#f", "<p>same"), (2, "https://a.example/ü y", "<p>same"), (3, None, None), (4, "http://c.example", ""), (5, "http://c.example", "é" * 5000), (5, "http://c.example", "é" * 5000), (6, "not a url", "a\r\n\r\nb"), (None, "http://d.example/", "<p>same")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "payload": F.lit("z")})
    directory = warc.write_index(warc.write_archives(frame))
    assert directory.columns == ["key", "last", "folder", "file"]  # no table of blocks: these are at the index files' ends
    read = lambda files, pages: warc.search(files, warc.with_keys(pages))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read(directory, frame).collect()), key=repr)
    assert got == sorted([(1, 7, "revisit", 2), (2, 7, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 10_000, "response", None), (5, 10_000, "response", None), (6, 6, "response", None), (None, 7, "revisit", 2)], key=repr)
    found = warc.lookup(directory, spark.createDataFrame([("http://b.example/x?q=1",), ("http://c.example/",), ("http://none.example/",), ("not a url",)], "url string")).collect()
    assert sorted((r._searched, r.page_id) for r in found) == [("http://b.example/x?q=1", 1), ("http://c.example/", 4), ("http://c.example/", 5), ("http://c.example/", 5), ("not a url", 6)]
    assert next(r for r in found if r.page_id == 6).payload == b"a\r\n\r\nb"
    assert read(warc.write_index(warc.write_archives(frame.limit(0))), frame).count() == 0
    assert {r.record_type for r in read(warc.write_index(warc.write_archives(frame.limit(2), 8)), frame).collect()} == {"response"}


def test_records_have_ids_of_their_own(spark):
    frame = spark.createDataFrame([(5, "http://c.example", "x")] * 3 + [(4, None, "x")] * 2, "page_id long, url string, html string")
    found = []
    for row in warc.write_archives(frame).collect():
        fs, top = warc.open_fs(row.folder)
        with fs.open_input_file(f"{top}/{row.file}") as file:
            found.append(warc.parse(warc.zlib.decompress(file.read_at(row.length, row.offset), 31)))
    assert len({x["record_id"] for x in found}) == 5 and sorted((x["page_id"], x["record_type"]) for x in found) == [(4, "revisit")] * 2 + [(5, "response")] * 3


def test_a_hot_key_and_long_keys(spark, monkeypatch):
    """A key with many captures goes over several index files and blocks; all others are found beside it."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    urls = [None] * 120 + [f"http://a{i}.example/" for i in range(30)] + ["http://z.example/" + "x" * 100_000] * 2
    frame = spark.createDataFrame([(i, u, str(i)) for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = warc.write_index(warc.write_archives(frame))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 2 and files.filter("key = ''").count() > 1
    assert sorted(r.page_id for r in warc.search(files, warc.with_keys(frame)).collect()) == list(range(152))
    assert sorted(r.page_id for r in warc.lookup(files, frame.filter("page_id in (3, 125, 150)").select("url")).collect()) == [*range(120), 125, 150, 151]


def test_index_of_many_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    frame = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example/"), F.col("id") % 50).alias("url"), F.col("id").cast("string").alias("html"))
    directory = warc.write_index(warc.write_archives(frame))
    want = sorted((r.url, r.page_id) for r in frame.collect())
    got = warc.lookup(directory, frame.select("url").distinct()).collect()
    assert sorted((r._searched, r.page_id) for r in got) == want


# op5


def brute_quality(values):
    import re

    out = []
    for t in values:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {k for i, r in enumerate(runs) if runs.count(r) > 1 for k in (i, i + 1, i + 2)} if len(words) < 500 else (set(range(len(words))) if len(set(words)) == 1 else set())
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)))
    return out


def test_quality(spark):
    values = [*texts(2), "a b c a b c " * 30, "# $ | <x> " * 20, "l1\nl1\nl2\r\n\nl2\r"]
    rows, _ = quality.judged(documents(spark, values))
    got = {r._doc: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows.collect()}
    assert [got[i] for i in range(len(values))] == brute_quality(values)
    assert quality.judged(empty(spark))[0].count() == 0


def test_common_lines(spark):
    rng = random.Random(4)
    own = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    footer = "Page 12 of   the common footer with quite a few words in it so that it weighs"
    values = [own(60) + "\n" + footer.replace("12", str(i)) for i in range(60)] + [own(20) + "\n" + "\n".join([footer] * 4), None, own(70)]
    docs = documents(spark, values).withColumn("source", F.lit("h"))
    rows, common = quality.judged(docs, 0.1, 20)
    got = {r._doc: r for r in rows.collect()}
    assert common.count() == 1 and got[0].n_removed_words == 17 and got[0].kept and got[62].kept
    assert not got[60].base_failed or got[60].n_removed_words == 68
    assert not got[60].kept and not got[61].kept
    left = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert left[0] == values[0].split("\n")[0] and 60 not in left and left[62] == values[62]


def test_copies_stay(spark):
    rng = random.Random(6)
    text = " ".join(rng.choice(WORDS) for _ in range(90))
    values = [text] * 30 + [" ".join(rng.choice(WORDS) for _ in range(90)) for _ in range(400)]
    rows, _ = quality.judged(documents(spark, values).withColumn("source", F.lit("h")))
    assert rows.filter("kept").count() == 430


def test_large_groups_of_copies_stay_in_the_pipeline(spark):
    rng = random.Random(7)
    own = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    footer = "the footer that all of these documents share"
    copy = own(60) + "\n" + own(30)
    values = [copy] * 60 + [copy + "\n" + footer] * 30 + [own(80) + "\n" + footer for _ in range(60)]
    docs = documents(spark, values).withColumn("source", F.lit("h"))
    left = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert left == {i: t.removesuffix("\n" + footer) for i, t in enumerate(values)}


def test_the_limit_of_a_large_host_is_no_share_in_the_pipeline(spark):
    rng = random.Random(8)
    own = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    footer, rare = "a footer of one document in fifteen", "a line of one document in a hundred"
    values = [own(60) + ("\n" + footer if i % 15 == 0 else "\n" + rare if i % 100 == 1 else "") for i in range(1500)] + [own(20) + "\n" + "\n".join([footer] * 20)]
    docs = documents(spark, values).withColumn("source", F.lit("h"))
    left = {r.doc_id: r.text for r in quality.clean(docs).collect()}
    assert 1500 not in left and left == {i: t.removesuffix("\n" + footer) for i, t in enumerate(values[:1500])}


# op6, op9


def test_encoder_equals_the_library():
    worker = tokens.encoder(tokens.default_path())
    odd = ["", " ", "a<|endoftext|>b c", "ΟΔΟΣ ΣΑΣ", "x\x1cy", "İstanbul ﬁ é  z", "don't we'll '''s 12ab3 rock'n'roll", "a\tb\nc  d\r\n", "“q”—dash…€5", "🙂 漢字", "ÀÉß×÷ÿ naïve", "a" * 3000, "<|startoftext|>", "'", "''s", "\x00 \x7f"]
    values = [*odd, *(t or "" for t in texts(3))]
    want = [np.array(e.ids, "<u4").tobytes() for e in worker.tokenizer.encode_batch(values, add_special_tokens=False)]
    assert worker.encode(values) == want and worker.encode(values) == want


def test_encoder_starts_anew(monkeypatch):
    worker = tokens.TextEncoder(tokens.default_path())
    monkeypatch.setattr(tokens, "MOST_PARTS", 50)
    values = [t or "" for t in texts(3)]
    assert worker.encode(values) == [np.array(e.ids, "<u4").tobytes() for e in worker.tokenizer.encode_batch(values, add_special_tokens=False)]


def ids_of(values, end):
    tokenizer = tokens.encoder(tokens.default_path()).tokenizer
    return [np.array([*e.ids, end], "<u4") for e in tokenizer.encode_batch([t or "" for t in values], add_special_tokens=False)]


def test_archive(spark):
    values = texts(4)
    manifest, freq = rans.write_archive(documents(spark, values, [10 * i for i in range(len(values))]))
    got = rans.read_archive(manifest, freq).orderBy("doc_id").collect()
    want, at = ids_of(values, 1), 0
    for i, (row, ids) in enumerate(zip(got, want, strict=True)):
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, bytes(row.ids)) == (10 * i, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    manifest, freq = rans.write_archive(empty(spark))
    assert rans.read_archive(manifest, freq).count() == 0


def test_archive_of_shared_and_null_ids(spark):
    manifest, freq = rans.write_archive(documents(spark, ["b", "a", None], [5, 5, None]))
    rows = sorted(rans.read_archive(manifest, freq).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 5, 5] and [r.start for r in rows] == [0, 1, 3]


def test_archive_of_a_huge_text_and_a_hot_id(spark):
    values = ["word and word " * 150_000, *["a b c"] * 300]
    manifest, freq = rans.write_archive(documents(spark, values, [2, *[1] * 300]))
    rows = sorted(rans.read_archive(manifest, freq).collect(), key=lambda r: r.start)
    small, large = ids_of(["a b c", values[0]], 1)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [*((1, i * len(small), len(small)) for i in range(300)), (2, 300 * len(small), len(large))]
    assert bytes(rows[-1].ids) == large.tobytes()


@pytest.mark.parametrize("n", [0, 1, rans.LANES - 1, rans.LANES, 5 * rans.LANES + 3, 600 * rans.LANES + 1])
def test_coder(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 4999).astype(np.int64)
    freq = rans.table(np.bincount(ids, minlength=5000) + (np.arange(5000) % 7 == 0))
    assert freq.sum() == 1 << rans.SCALE_BITS
    coder = rans.Coder(freq)
    block = rans.pack_block(coder, [1, 2], [n, 0], ids, 77)
    doc_ids, lengths, first, back = rans.unpack_block(coder, block)
    assert back.tolist() == ids.tolist() and lengths.tolist() == [n, 0] and first == 77
    if n > rans.CHECK_ROWS * rans.LANES:
        assert rans.unpack_block(coder, block, 0)[3].tolist() == ids[rans.CHECK_ROWS * rans.LANES :].tolist()
        assert rans.unpack_block(coder, block, 1)[3].tolist() == ids[2 * rans.CHECK_ROWS * rans.LANES :].tolist()
    with pytest.raises(ValueError, match="damaged"):
        rans.unpack_block(coder, block[:-1] + bytes([block[-1] ^ 1]) if n > 600 else block[:40] + bytes([block[40] ^ 1]) + block[41:])


def test_table_with_more_ids_than_fit_evenly():
    counts = np.zeros(3000, np.int64)
    counts[0], counts[1:] = 10**12, 1
    freq = rans.table(counts, 12)
    assert freq.sum() == 4096 and freq.min() == 1


def test_packing(spark):
    values = [*texts(5), "tail " * 9000]
    rows = packing.pack(documents(spark, values)).collect()
    want = ids_of(values, 0)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, ids in enumerate(want):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(k, 2048 * k, min(2048, len(ids) - 2048 * k)) for k in range(-(-len(ids) // 2048))]
        assert b"".join(bytes(p.ids) for p in pieces) == ids.tobytes() and all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in pieces)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, want))
    assert len(sequences) <= 1.15 * -(-total // 2048) + 1
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, int(rng.integers(0, 300))), minlength=65)
    found = packing.plan(counts, 64)
    used = np.zeros(65, np.int64)
    for pattern, times in found:
        assert sum(k * v for k, v in pattern.items()) <= 64
        for k, v in pattern.items():
            used[k] += v * times
    assert used.tolist() == counts.tolist()


def histogram(n, seed, window):
    return np.bincount(np.clip(np.random.default_rng(seed).lognormal(np.log(window) - 2, 0.9, n), 1, window).astype(int), minlength=window + 1)


@pytest.mark.parametrize("n", [300, 1200, 12_000])
def test_most_sequences_are_patterns_of_the_fit(n):
    counts = histogram(n, n, 512)
    found, fitted = packing.fitted_plan(counts, 512)
    bound, full = -(-int((np.arange(513) * counts).sum()) // 512), int(counts[512])
    by_fit, all_ = sum(t for _, t in found[:fitted]), sum(t for _, t in found)
    assert all_ <= bound + 1 and by_fit - full > 0.5 * (all_ - full)
    assert all(sum(k * v for k, v in pattern.items()) == 512 for pattern, _ in found[:fitted])


def test_the_fit_settles_at_the_histogram():
    counts = histogram(5000, 1, 256)
    lengths, times = packing.patterns(counts, 256)
    x = packing.fit(counts, lengths, times)
    summed = np.bincount(lengths.ravel(), weights=(np.where(lengths > 0, times, 0) * x[:, None]).ravel(), minlength=257)
    assert x.min() >= 0 and np.abs(summed - counts)[1:].sum() < 0.02 * counts.sum()
    used = np.arange(257) @ counts / 256
    assert abs(x.sum() - used) < 0.02 * used  # no more sequences asked for than there are tokens


def test_patterns_are_all_that_fill_a_sequence():
    counts = np.zeros(25, np.int64)
    counts[[2, 3, 5, 7, 8, 12, 17, 24]] = [9, 2, 1, 3, 3, 2, 1, 4]
    lengths, times = packing.patterns(counts, 24)
    got = {tuple(sorted((a, t) for a, t in zip(x, n) if a)) for x, n in zip(lengths.tolist(), times.tolist())}
    want = set()
    present = np.flatnonzero(counts).tolist()
    for a in present:
        for i in range(1, int(counts[a]) + 1):
            if i * a == 24:
                want.add(((a, i),))
            for b in present:
                for j in range(1, int(counts[b]) + 1):
                    if b < a and i * a + j * b == 24:
                        want.add(((b, j), (a, i)))
                    for c in present:
                        if i == j == 1 and c < b < a and a + b + c == 24:
                            want.add(((c, 1), (b, 1), (a, 1)))
    assert got == want and len(got) == len(lengths)


def test_packing_of_one_hot_length_and_null_ids(spark):
    values = ["same text " * 3] * 500 + [None, "", "other words " * 40]
    rows = packing.pack(documents(spark, values, [None] * 250 + list(range(253)))).collect()
    assert len(rows) == 503 and sum(r.doc_id is None for r in rows) == 250
    assert len({(r.sequence_id, r.offset) for r in rows}) == 503
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) == -(-sum(used.values()) // 2048)


# op7


def test_unigram_counts_equal_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("▁", -2.0), ("▁a", -2.5), ("a", -3.0), ("b", -3.0), ("ab", -6.0), ("ba", -5.0), ("bab", -8.0), ("aba", -8.0), ("▁ab", -5.5), ("é", -4.0), ("c", -3.5)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    rng = random.Random(0)
    values = ["".join(rng.choice("abc é▁zz漢") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", " ", "  ", "▁", "zzz"]
    counted = unigram.Counter(vocabulary).counts(values)
    assert [c[0] for c in counted] == [len(e.ids) for e in library.encode_batch(values)]
    rows = unigram.token_counts(documents(spark, [None, "", "ab ab"])).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows][:2] == [0, 0] and rows[2].n_tokens > 0


def test_unigram_scores_and_long_words():
    """Scores of the best of all ways to cut short words; a word far longer than what is held, cut at places where the best way must part."""
    import itertools

    vocabulary = {"\u2581": -2.0, "\u2581a": -2.5, "a": -3.0, "b": -3.25, "ab": -6.0, "ba": -5.0, "bab": -8.0, "aab": -7.5}
    worker = unigram.Counter(list(vocabulary.items()))
    low = min(vocabulary.values()) - unigram.UNKNOWN_PENALTY
    for n in range(1, 8):
        for word in map("".join, itertools.product("ab?", repeat=n)):
            cuts = ([word[i:j] for i, j in zip((0, *c), (*c, n))] for k in range(n) for c in itertools.combinations(range(1, n), k))
            best = max(sum(vocabulary.get(p, low) for p in c) for c in cuts if all(p in vocabulary or len(p) == 1 for p in c))
            assert worker.word(word)[2] == pytest.approx(best)
    # "?" is no part of a piece: what is between two of them is cut by itself
    parts = ["abab", "baab", "bb"]
    pieces, unknown, score = (sum(x) for x in zip(*(worker.word(p) for p in parts)))
    assert worker.word("?".join(parts * 4000)) == (pytest.approx(4000 * pieces + 11_999), 11_999, pytest.approx(4000 * score + 11_999 * low))


def test_unigram_of_long_texts_and_an_empty_table(spark):
    rows = unigram.token_counts(documents(spark, ["x" * 300_000, "a b " * 50_000, None])).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [0, 1, 2] and rows[0].n_tokens > 1000 and rows[1].n_tokens >= 100_000 and rows[2].score == 0
    assert unigram.token_counts(empty(spark)).count() == 0


# op8


def brute_sets(values):
    import re

    out = []
    for t in values:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_jaccard(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard, "PART", 3)
        monkeypatch.setattr(jaccard, "PIVOTS", 1)
        monkeypatch.setattr(jaccard, "COMMON_IN_BATCH", 2)
    rng = random.Random(9)
    family = [rng.choice(WORDS) for _ in range(150)]
    copies = []
    for _ in range(30):
        words = list(family)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(150)] = rng.choice(WORDS)
        copies.append(" ".join(words))
    values = [*texts(6), *copies]
    sets, forest = brute_sets(values), Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                forest.join(i, j)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(documents(spark, values), block=500 if small else 400_000).collect()}
    assert got == {i: (len(s), forest.root(i)) for i, s in enumerate(sets)}
    if not small:
        kept = sorted(r.doc_id for r in jaccard.representatives(documents(spark, values)).collect())
        assert kept == [i for i in range(len(values)) if forest.root(i) == i]
        assert jaccard.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("most", [1000, 7])
def test_jaccard_counts_common_shingles_over_all_tasks(spark, monkeypatch, most):
    """A passage that few documents of any batch hold, and more in all, makes no group."""
    monkeypatch.setattr(jaccard, "COMMON_IN_BATCH", 3)
    monkeypatch.setattr(jaccard, "MOST_COMMON", most, raising=False)
    monkeypatch.setattr(jaccard, "COUNTED_AT_ONCE", 100, raising=False)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, " ".join([f"w{rng.random()}" for _ in range(120)] + [passage] * (k % 4 == 0))) for k in range(40)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 40), "doc_id long, text string")
    common = jaccard.common_shingles(docs)
    assert len(common) == min(most, 26)
    grouped = jaccard.prefix_tokens(jaccard.described(docs, common)).groupBy("token").count().filter("count > 1").count()
    assert grouped == 0 if most > 26 else grouped <= 26 - most
    assert all(r.component_id == r.doc_id for r in jaccard.near_duplicates(docs).collect())


def test_jaccard_packed_counts_come_back():
    rng = np.random.default_rng(3)
    for values in (np.unique(rng.integers(0, 1 << 32, 500, np.uint64)), np.array([0], np.uint64), np.array([(1 << 32) - 1], np.uint64)):
        counts = rng.integers(1, 1 << 20, len(values)).astype(np.uint64)
        got = jaccard.counts_unpacked(jaccard.counts_packed(values, counts))
        assert np.array_equal(got[0], values) and np.array_equal(got[1], counts)


def test_jaccard_shared_and_null_ids(spark):
    long = " ".join(WORDS[:60])
    rows = jaccard.near_duplicates(documents(spark, [long, long, "other text of five words", None], [7, None, 7, 8])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(0, 56, 7), (7, 1, 7), (7, 56, 7), (8, 0, 8)]


@pytest.mark.parametrize("seed", range(3))
def test_count_tree_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 60, 400)
    vectors = np.stack([np.bincount(rng.integers(0, jaccard.GROUPS, k), minlength=jaccard.GROUPS) for k in n])
    vectors[200:] = vectors[:200]
    n[200:] = n[:200]
    tree = jaccard.CountTree(n, vectors)
    for k in range(0, 400, 17):
        want = [j for j in range(400) if 5 * n[j] >= 4 * n[k] and 4 * n[j] <= 5 * n[k] and 9 * np.minimum(vectors[j], vectors[k]).sum() >= 4 * (n[j] + n[k])]
        assert sorted(tree.near(int(n[k]), vectors[k]).tolist()) == want


# op10


def brute_targets(sizes):
    """Sources in order with their words: shares by weight, what is above three times its own goes to the others."""
    weights, caps = {s: 1 + i % 3 for i, s in enumerate(sizes)}, {s: 3 * n for s, n in sizes.items()}
    out, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > caps[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = float(caps[s])
            open_.discard(s)
            left -= caps[s]


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 40, 41, 200])), rng.choices(["a", "b", "ü", None, "z"], [60, 20, 10, 8, 2])[0]) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, " \t", "only blanks"), (1003, "w " * 3000, "z"), (5, "x y", "b"), (5, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for columns in (("doc_id", "source"), None):
        got = mixing.mix(docs, columns).collect()
        assert len(got) == len(rows)
        size = {}
        for _, t, s in rows:
            size[s] = size.get(s, 0) + len((t or "").split())
        want = brute_targets(dict(sorted(size.items(), key=lambda x: (x[0] is None, (x[0] or "").encode()))))
        taken = {}
        for r in got:
            assert 0 <= r._copies <= 3 and r._source_size == size[r.source] and r._target == pytest.approx(want[r.source])
            taken[r.source] = taken.get(r.source, 0) + r._copies * r._size
        for s, target in want.items():
            assert abs(taken[s] - target) <= max((r._size for r in got if r.source == s), default=0)
    again = mixing.mix(docs.repartition(7), ("doc_id", "source")).collect()
    assert sorted((r.doc_id, r._copies) for r in again) == sorted((r.doc_id, r._copies) for r in got)
    assert mixing.mix(docs.limit(0), ("doc_id", "source")).count() == 0


def test_rates_are_exponential_in_size(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "a" if i % 4 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix(docs, ("doc_id", "source")).collect() if r.source == "a" and r._rate < 3]
    tilt = np.array([np.log(r._rate) / r._size for r in got])
    assert np.ptp(tilt) < 1e-9
    words = sum(r._rate * r._size for r in mixing.mix(docs, ("doc_id", "source")).collect() if r.source == "a")
    assert words == pytest.approx(got[0]._target, rel=1e-6)


def test_mixing_keeps_columns_with_clashing_names(spark):
    rows = [(i, "w " * (1 + i % 7), "a" if i % 3 else None, i, f"n{i}", 0.5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size long, _key string, _rate double")
    out = mixing.copied(docs).collect()
    assert set(map(tuple, out)) <= set(rows) and mixing.copied(docs).columns == docs.columns
    copies = {r.doc_id: r._copies for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    assert {i: sum(r.doc_id == i for r in out) for i in copies} == copies


def test_a_target_near_the_most_settles(spark):
    """Sources whose targets are just under three times their words, with very different sizes."""
    rows = [(i, "w " * (1 + (i % 5) ** 5), "big" if i % 10 else "small") for i in range(300)] + [(1000 + i, "w " * 3, f"s{i}") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("doc_id", "source")).collect()
    taken, target, most = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r._copies * r._size
        target[r.source], most[r.source] = r._target, max(most.get(r.source, 0), r._size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
