"""Quality rules: base measures of a text, and cross-document line frequency.

Lines are normalised (lower case, digit runs to 0, blanks to one space) and hashed. For each host (the
column source) the distinct documents with a line are counted; a line in more than MIN_DOCS documents and more than
MAX_SHARE of the host's documents is boilerplate. Such lines are removed, and a document that keeps less than
MIN_LEFT of its words is depleted and rejected.

The query counts doc_ids, as its SQL does: there a group of copies that is over MAX_SHARE of its host is rejected whole. The
pipeline (clean) counts bodies: documents of a host with the same set of normalised lines are one, so no document goes because it
has copies, and the Jaccard join is left one of each group. Near copies with lines of their own are several bodies. There the
limit is the square root of the host's bodies where that is less than MAX_SHARE of them, so it doesn't rise with the host.

Only hashes and counts are shuffled, never texts; a hot host or a hot line is pre-aggregated before it meets its limit.

Edge cases: a null text has no words and fails the base rules. A null source is a host of its own. Rows with the same
doc_id and text count as one document of the host and get the same verdict. A null doc_id counts as one document. An empty table gives
no rows. The operator's own columns are prefixed, so names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import map_batches, sheltered, slices, text_bytes, text_column, written
from tessera.llm.wordhash import BLANK, SLICE, windows, word_hashes, word_spans

MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_SHARE = 0.1
MIN_DOCS = 20
MIN_LEFT = 0.5
NULL_ID = -(1 << 63)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
DIGITS = regex.compile("[0-9]+")
BLANKS = regex.compile("[\\x20\\x09-\\x0D]+")
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def line_hash(line: str) -> int:
    """Of the normalised line, signed 64-bit."""
    normal = DIGITS.sub("0", BLANKS.sub(" ", line).strip(" ").lower())
    return int.from_bytes(hashlib.blake2b(normal.encode(), digest_size=8).digest(), "little", signed=True)


def repeated_words(words: np.ndarray) -> int:
    """Words inside three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    runs = windows(words, 3)
    ordered = np.sort(runs)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(runs, again)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= hit
    return int(covered.sum())


def base_measures(column: pa.Array) -> dict[str, np.ndarray]:
    """The columns of BASE but the last for each text."""
    raw, at = text_bytes(column)
    out = {k: np.zeros(len(column), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for first, end in slices(at, SLICE):
        data, offsets = raw[at[first] : at[end]], at[first : end + 1] - at[first]
        starts, ends, by_doc = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=False)
        code_points = np.concatenate([[0], np.cumsum(~BLANK[data] & ((data & 0xC0) != 0x80))])
        symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
        out["n_words"][first:end] = np.diff(by_doc)
        out["word_chars"][first:end] = np.diff(code_points[offsets])
        out["n_symbols"][first:end] = np.diff(symbols[offsets])
        out["n_repeat_words"][first:end] = [repeated_words(hashes[a:b]) for a, b in zip(by_doc[:-1].tolist(), by_doc[1:].tolist())]
    for row, text in enumerate(column.to_pylist()):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            out["n_dup_lines"][row] = len(lines) - len(set(lines))
    return out


def host_key(docs: DataFrame) -> Column:
    """The source, so that null is a key too."""
    return F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("n"))


def measured(docs: DataFrame, min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED) -> DataFrame:
    """_doc, _host, _id (of doc, host and text), _body (of the set of lines), the base measures and _lines (hash, words) of each document: no texts."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = text_column(batch)
        base, texts = base_measures(column), column.to_pylist()
        failed = (base["n_words"] < min_words) | (base["n_repeat_words"] > max_repeated * base["n_words"])
        lines = [[{"h": line_hash(x), "n": len(BLANKS.sub(" ", x).strip(" ").split(" "))} for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for t in texts]
        ids = [hashlib.blake2b(f"{d} {h} {t}".encode(), digest_size=16).digest() for d, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts)]
        bodies = [hashlib.blake2b(np.unique(np.array([x["h"] for x in ls], np.int64)).tobytes(), digest_size=16).digest() for ls in lines]
        return pa.record_batch({"_doc": batch.column(0), "_host": batch.column(1), "_mark": pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), "_id": pa.array(ids, pa.binary()), "_body": pa.array(bodies, pa.binary())} | {k: pa.array(v) for k, v in base.items()} | {"base_failed": pa.array(failed), "_lines": pa.array(lines, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))})

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("_doc"), host_key(docs).alias("_host"), "text"), step, f"_doc long, _host string, _mark binary, _id binary, _body binary, {BASE}, _lines array<struct<h: long, n: long>>")


def common_lines(rows: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, unit: str = "_doc") -> DataFrame:
    """_host, _h of the lines that too many documents of their host have; unit: what is one document, _doc or _body."""
    docs = rows.select("_host", unit).distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    lines = rows.select("_host", unit, F.explode(F.array_distinct(F.col("_lines.h"))).alias("_h"))
    counts = lines.distinct().groupBy("_host", "_h").agg(F.count("*").alias("_n")).filter(F.col("_n") > min_docs)
    limit = max_share * F.col("_docs")
    if unit == "_body":
        limit = F.least(limit, F.sqrt("_docs"))
    return counts.join(docs, "_host").filter(F.col("_n") > limit).select("_host", "_h")


def judged(docs: DataFrame, max_share: float = MAX_SHARE, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT, unit: str = "_doc") -> tuple[DataFrame, DataFrame]:
    """(a row a document: _doc, _host, _id, the measures, n_removed_words, kept; the common lines)"""
    rows = written(measured(docs), "measures")
    common = written(common_lines(rows, max_share, min_docs, unit), "lines")
    words = rows.select("_host", "_id", F.explode("_lines").alias("_l")).select("_host", "_id", F.col("_l.h").alias("_h"), F.col("_l.n").alias("_n"))
    removed = words.join(common, ["_host", "_h"]).groupBy("_id").agg(F.sum("_n").alias("_removed"), F.collect_set("_h").alias("_gone"))
    twice = rows.groupBy("_id").agg(F.count("*").alias("_rows")).filter("_rows > 1")
    out = rows.drop("_lines").join(removed, "_id", "left").join(twice, "_id", "left")
    out = out.withColumn("n_removed_words", F.floor(F.coalesce("_removed", F.lit(0)) / F.coalesce("_rows", F.lit(1))).cast("long")).drop("_removed", "_rows")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words"))), common


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their common lines removed from the text (and n_chars set anew); the columns of docs."""
    verdicts, _ = judged(docs, unit="_body")
    rows, restored = sheltered(docs, "doc_id", "text", "source")
    hosted = rows.withColumns({"_host": host_key(rows), "_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))})
    kept = verdicts.filter("kept").select(F.coalesce("_doc", F.lit(NULL_ID)).alias("_key"), "_host", "_mark", F.col("_gone").alias("_common")).dropDuplicates(["_key", "_host", "_mark"])
    marked = hosted.withColumn("_mark", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    wide = marked.join(kept, ["_key", "_host", "_mark"]).drop("_key", "_host", "_mark")
    schema = T.StructType([f for f in wide.schema if f.name != "_common"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [n for n in batch.schema.names if n != "_common"]
        place = names.index("text")
        out, known = [], {}
        for text, lines in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("_common")).to_pylist()):
            if lines and text:
                gone = known.setdefault(tuple(lines), set(lines))
                text = "\n".join(x for x in text.split("\n") if not x.strip(" \t\n\v\f\r") or line_hash(x) not in gone)
            out.append(text)
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        columns[place] = pa.array(out, pa.string())
        return pa.record_batch(columns, names=names)

    out = restored(map_batches(wide, step, schema))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return verdicts.select(F.col("_doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


_W = r"'[^\x20\x09-\x0D]+'"
_NORMAL = r"regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), '[0-9]+', '0', 'g')"
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, {_W}) AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_W})) AS lines FROM d),
t AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
u AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM u WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, lines, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
l AS (SELECT doc_id, source, {_NORMAL} AS line, len(regexp_extract_all(line, {_W})) AS n FROM (SELECT doc_id, source, unnest(lines) AS line FROM w)),
h AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
c AS (SELECT l.source, line FROM l JOIN h ON l.source = h.source GROUP BY l.source, line, docs HAVING count(DISTINCT doc_id) > {MIN_DOCS} AND count(DISTINCT doc_id) > {MAX_SHARE} * docs),
g AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM l JOIN c ON l.source = c.source AND l.line = c.line GROUP BY doc_id),
v AS (SELECT b.*, coalesce(g.n, 0) AS n_removed_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b LEFT JOIN g ON b.doc_id = g.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= {MIN_LEFT} * n_words AS kept, n_removed_words FROM v
"""
