"""What results are written as: canonical and pretty JSON, JSON lines, quoted CSV, SARIF, diagrams, histories, saved indexes, bundles, blob stores.

The expressions give a column of text, so that any writer can take it; nothing is brought to the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a command history as CSV.
HISTORY_HEADER = "Timestamp,Command,Working Directory,Status,Exit Code"
HISTORY = ["timestamp", "command", "cwd", "status", "exit_code"]
#: SARIF's version, schema and levels.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}


def canonical_json(rows: DataFrame) -> DataFrame:
    """json of each row: columns in the order of their names, no blanks, nulls written."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def pretty_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes a frame of one text column."""
    lines.write.text(path)


def json_lines(paths: DataFrame) -> DataFrame:
    """line: {"path": ...} of each path."""
    return paths.select(F.to_json(F.struct("path")).alias("line"))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def quoted_csv(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """line: all fields quoted, quotes doubled, nulls empty."""
    return rows.select(F.concat_ws(",", *(quoted(F.col(c)) for c in columns or rows.columns)).alias("line"))


def history_csv(history: DataFrame) -> DataFrame:
    """position, line: the header, and a line for each row in the order of `position`."""
    head = history.sparkSession.createDataFrame([(-1, HISTORY_HEADER)], "position long, line string")
    return head.unionByName(history.select(F.col("position").cast("long").alias("position"), F.concat_ws(",", *(quoted(F.col(c)) for c in HISTORY)).alias("line")))


def sarif(findings: DataFrame, tool: str = "tessera") -> DataFrame:
    """json: one SARIF log of all findings (rule, severity, confidence, evidence, file, line), rules and results in order. A log is one document, so it is one row."""
    level = F.coalesce(*(F.when(F.col("severity") == s, F.lit(v)) for s, v in SARIF_LEVELS.items()), F.lit("none"))
    uri = F.coalesce(F.replace("file", F.lit("\\"), F.lit("/")), F.lit("unknown"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    text = F.concat(F.lit("["), F.col("confidence"), F.lit("] "), F.col("evidence"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    rule = F.struct(F.col("rule").alias("id"), F.replace(F.initcap(F.replace("rule", F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("")).alias("name"), F.struct(F.replace("rule", F.lit("-"), F.lit(" ")).alias("text")).alias("shortDescription"))
    one = findings.agg(F.sort_array(F.collect_set(rule)).alias("rules"), F.sort_array(F.collect_list(F.struct(F.col("rule"), F.col("file"), F.col("line"), result.alias("r")))).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.transform("results", lambda x: x["r"]).alias("results"))
    return one.select(F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))).alias("json"))


def diagram(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """line: a task graph as a Mermaid diagram: an edge for each need (task, need), a node for a task without."""
    rows = tasks.select("task").join(needs, "task", "left").select("task", F.when(F.col("need").isNull(), F.concat(F.lit("    "), "task", F.lit(";"))).otherwise(F.concat(F.lit("    "), "need", F.lit(" --> "), "task", F.lit(";"))).alias("line"), "need")
    return rows.orderBy("task", "need").select("line")


def record_analysis(analysis: DataFrame, hits: DataFrame, folder: str) -> None:
    """Appends a run (id, ...) and its rule hits (id, ...) to two tables that share the id."""
    analysis.write.mode("append").parquet(f"{folder}/analyses")
    hits.write.mode("append").parquet(f"{folder}/rule_hits")


def save_index(frames: dict[str, DataFrame], folder: str) -> None:
    """Writes an index's tables side by side; load_index() gives all of them again, nothing lost."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def manifest(files: DataFrame) -> DataFrame:
    """path, size, sha256 of files (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def bundle(files: DataFrame) -> DataFrame:
    """content: one ZIP archive of the files and their manifest, the same bytes for the same files: names in order, times fixed. An archive is one file, so one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, listed = io.BytesIO(), []

        def add(archive: zipfile.ZipFile, name: str, data: bytes) -> None:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            archive.writestr(info, data)

        with zipfile.ZipFile(out, "w") as archive:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = content.as_py() or b""
                    add(archive, path, data)
                    listed.append({"path": path, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data)})
            add(archive, "manifest.json", json.dumps(listed, sort_keys=True, separators=(",", ":")).encode())
        yield pa.record_batch([pa.array([out.getvalue()], pa.binary())], names=["content"])

    return files.select("path", "content").repartition(1).sortWithinPartitions("path").mapInArrow(run, "content binary")


def blobs(files: DataFrame) -> DataFrame:
    """name (the digest), content: each content once."""
    return files.select(F.sha2("content", 256).alias("name"), "content").dropDuplicates(["name"])


def store_blobs(files: DataFrame, folder: str) -> DataFrame:
    """Adds the contents that the store (a table by digest) does not have; gives name and path of every file."""
    spark = files.sparkSession
    new = blobs(files)
    try:
        new = new.join(spark.read.parquet(folder).select("name"), "name", "left_anti")
    except Exception as e:  # an empty store has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(folder)
    return files.select(F.sha2("content", 256).alias("name"), "path")


def restore_blobs(spark: SparkSession, folder: str, named: DataFrame) -> DataFrame:
    """path, content of files (name, path) from the store."""
    return named.join(spark.read.parquet(folder), "name").select("path", "content")
