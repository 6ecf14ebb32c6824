"""Looking into files: ragged CSV, broken JSON lines, archive entries, text diffs. Frames of texts have path and body, of files path and content."""

from __future__ import annotations

import csv
import difflib
import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_JSON_ERRORS = 10
#: Bytes that an archive's entries may have in all, and how many there may be.
MOST_EXPANDED, MOST_ENTRIES = 1 << 30, 10_000


def each_row(frame: DataFrame, step: Callable[..., list[tuple]], names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """mapInArrow with a function that gives rows for the columns of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns)) for out in step(*row)]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return frame.mapInArrow(run, schema)


def csv_widths(texts: DataFrame) -> DataFrame:
    """path, width, n: rows of CSV texts by their number of fields; a text that is no CSV has width null."""

    def step(path: str, body: str | None) -> list[tuple]:
        counts: dict[int | None, int] = {}
        try:
            for row in csv.reader(io.StringIO(body or ""), strict=True):
                counts[len(row)] = counts.get(len(row), 0) + 1
        except csv.Error:
            counts = {None: 1}
        return [(path, width, n) for width, n in counts.items()]

    return each_row(texts.select("path", "body"), step, ["path", "width", "n"], [pa.string(), pa.int32(), pa.int64()], "path string, width int, n long")


def ragged(texts: DataFrame) -> DataFrame:
    """csv_widths() of the texts with more than one width."""
    rows = csv_widths(texts)
    several = rows.groupBy("path").agg(F.count("*").alias("_w")).filter("_w > 1").select("path")
    return rows.join(several, "path", "left_semi")


def json_line_errors(texts: DataFrame) -> DataFrame:
    """path, line, column, message of the first ten lines of a text that are neither blank nor JSON."""

    def step(path: str, body: str | None) -> list[tuple]:
        out = []
        for number, line in enumerate((body or "").splitlines(), 1):
            if line.strip():
                try:
                    json.loads(line)
                except json.JSONDecodeError as e:
                    out.append((path, number, e.colno, e.msg))
                    if len(out) == MOST_JSON_ERRORS:
                        break
        return out

    return each_row(texts.select("path", "body"), step, ["path", "line", "column", "message"], [pa.string(), pa.int32(), pa.int32(), pa.string()], "path string, line int, column int, message string")


def json_error(texts: DataFrame) -> DataFrame:
    """path, line, column, message of texts that are no JSON."""

    def step(path: str, body: str | None) -> list[tuple]:
        try:
            json.loads(body or "")
        except json.JSONDecodeError as e:
            return [(path, e.lineno, e.colno, e.msg)]
        return []

    return each_row(texts.select("path", "body"), step, ["path", "line", "column", "message"], [pa.string(), pa.int32(), pa.int32(), pa.string()], "path string, line int, column int, message string")


def zip_entries(files: DataFrame) -> DataFrame:
    """path, entry, content of ZIP archives. Raises where an archive would expand beyond MOST_EXPANDED bytes or MOST_ENTRIES entries; an archive that is none gives no rows."""

    def step(path: str, content: bytes | None) -> list[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except zipfile.BadZipFile:
            return []
        found = archive.infolist()
        if len(found) > MOST_ENTRIES or sum(x.file_size for x in found) > MOST_EXPANDED:
            raise ValueError(f"{path} expands beyond the limits")
        return [(path, x.filename, archive.read(x)) for x in found if not x.is_dir()]

    return each_row(files.select("path", "content"), step, ["path", "entry", "content"], [pa.string(), pa.string(), pa.binary()], "path string, entry string, content binary")


def unified_diffs(before: DataFrame, after: DataFrame, around: int = 3) -> DataFrame:
    """path, diff of the texts that differ, appeared or went, with `around` lines about each change. Equal texts drop out before a line is compared."""
    a, b = before.select("path", F.col("body").alias("_a")), after.select("path", F.col("body").alias("_b"))
    changed = a.join(b, "path", "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))

    def step(path: str, old: str | None, new: str | None) -> list[tuple]:
        lines = difflib.unified_diff((old or "").splitlines(keepends=True), (new or "").splitlines(keepends=True), path, path, n=around)
        return [(path, "".join(x.rstrip(" \n") + "\n" if x.startswith(("---", "+++")) else x for x in lines))]

    return each_row(changed.select("path", "_a", "_b"), step, ["path", "diff"], [pa.string(), pa.string()], "path string, diff string")
