"""Readers of text inputs: logs, change logs, snapshots, requirement files, lock files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import written

LINE = r"(?i)^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})\s+(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+(.*)$"
CHANGE = T.StructType([T.StructField("op", T.StringType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ttl", T.DoubleType()), T.StructField("ts", T.DoubleType()), T.StructField("_corrupt", T.StringType())])


def parsed_log(lines: DataFrame) -> DataFrame:
    """ts, level, message of a frame with the column value; all null where a line doesn't match. A time with a T between date and hour matches but has no ts."""
    value = F.trim("value")
    level = F.upper(F.regexp_extract(value, LINE, 2))
    found = level != ""
    return lines.select("*", F.when(found, F.try_to_timestamp(F.regexp_extract(value, LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"), F.when(found, level).alias("level"), F.when(found, F.regexp_extract(value, LINE, 3)).alias("message"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed_log(spark.read.text(path))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of one text file, in order: a change log is one ordered file.

    The file is read in blocks. A line's number is its place in its block and the lines of the blocks before, a row a block; no task sees the whole file.
    """
    place = F.monotonically_increasing_id()
    rows = written(spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), place.alias("_id")), "lines")
    blocks = rows.groupBy("_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = blocks.withColumn("_before", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).select("_block", "_first", "_before")
    return rows.join(before, "_block").select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line"), "value")


def change_log(lines: DataFrame) -> DataFrame:
    """seq, op, key, value, ttl, ts of JSON lines (line, value). Blank lines are skipped; a torn last line is dropped; another bad line raises."""
    full = lines.filter(F.trim("value") != "")
    rows = full.withColumn("r", F.from_json("value", CHANGE, {"columnNameOfCorruptRecord": "_corrupt"})).withColumn("_bad", F.col("r._corrupt").isNotNull() | F.col("r.op").isNull())
    last = rows.agg(F.max("line").alias("_last"))
    checked = rows.join(last).withColumn("_ok", F.when(F.col("_bad") & (F.col("line") < F.col("_last")), F.raise_error(F.concat(F.lit("damaged change log line "), F.col("line")))).otherwise(~F.col("_bad")).cast("boolean"))
    return checked.filter("_ok").select(F.col("line").cast("long").alias("seq"), "r.op", "r.key", "r.value", "r.ttl", "r.ts")


def key_value_log(lines: DataFrame, source: int = 1) -> DataFrame:
    """seq, source, op, key, value of PUT and DEL lines; a value loses its leading blanks, a key has none."""
    value = F.ltrim("value")
    op = F.regexp_extract(value, r"^(PUT|DEL)\s+(\S+)\s*(.*)$", 1)
    return lines.select(F.col("line").cast("long").alias("seq"), F.lit(source).alias("source"), op.alias("op"), F.regexp_extract(value, r"^(PUT|DEL)\s+(\S+)\s*(.*)$", 2).alias("key"), F.regexp_extract(value, r"^(PUT|DEL)\s+(\S+)\s*(.*)$", 3).alias("value")).filter("op <> ''")


def snapshot(lines: DataFrame) -> DataFrame:
    """The same of 'key value' lines."""
    value = F.ltrim("value")
    return lines.select(F.col("line").cast("long").alias("seq"), F.lit(0).alias("source"), F.lit("PUT").alias("op"), F.regexp_extract(value, r"^(\S+)\s*(.*)$", 1).alias("key"), F.regexp_extract(value, r"^(\S+)\s*(.*)$", 2).alias("value")).filter("key <> ''")


def requirements(lines: DataFrame) -> DataFrame:
    """name, extras, spec, marker, direct_url of requirement lines (value). A # starts a comment at the line's start or after a blank only."""
    text = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    text = F.trim(F.regexp_replace(text, r"\s--hash=\S+", ""))
    url = F.regexp_extract(text, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*@\s*(\S+)", 3)
    shape = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[([^\]]*)\])?\s*\(?([^;@()]*)\)?\s*(?:;(.*))?$"
    plain = lambda k: F.regexp_extract(text, shape, k)
    named = F.regexp_extract(text, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    rows = lines.select(named.alias("name"), F.filter(F.split(F.regexp_replace(plain(2), r"\s", ""), ","), lambda x: x != "").alias("extras"), F.trim(F.when(url == "", plain(3)).otherwise("")).alias("spec"), F.trim(plain(4)).alias("marker"), F.when(url != "", url).alias("direct_url"))
    return rows.filter("name <> ''")


ENTRY = T.MapType(T.StringType(), T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("resolved", T.StringType()), T.StructField("integrity", T.StringType()), T.StructField("link", T.BooleanType()), T.StructField("dev", T.BooleanType()), T.StructField("optional", T.BooleanType()), T.StructField("hasInstallScript", T.BooleanType()), T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())), T.StructField("devDependencies", T.MapType(T.StringType(), T.StringType())), T.StructField("optionalDependencies", T.MapType(T.StringType(), T.StringType()))]))


def lock_packages(files: DataFrame) -> DataFrame:
    """location, name, version, resolved, integrity, link, install_script, wants of lock files in the flat layout (column value: the JSON)."""
    entries = files.select(F.explode(F.from_json("value", T.StructType([T.StructField("packages", ENTRY)]))["packages"]).alias("location", "p"))
    wants = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.map_keys(f"p.{c}") for c in ("dependencies", "devDependencies", "optionalDependencies"))))))
    return entries.select("location", F.coalesce("p.name", F.regexp_extract("location", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)).alias("name"), F.coalesce("p.version", F.lit("")).alias("version"), "p.resolved", "p.integrity", F.coalesce("p.link", F.lit(False)).alias("link"), F.coalesce("p.hasInstallScript", F.lit(False)).alias("install_script"), wants.alias("wants"))


def lock_edges(packages: DataFrame) -> DataFrame:
    """src, dst locations: a wanted name is looked up from the install path upwards, the nearest copy wins."""
    wanted = packages.select(F.col("location").alias("src"), F.explode("wants").alias("name"))
    parts = F.split("src", "(?:^|/)node_modules/")
    bases = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k + 1), "/node_modules/"), F.when(k + F.length(parts[0]) == 0, "node_modules/").otherwise("/node_modules/")))
    tried = wanted.select("src", "name", F.posexplode(bases).alias("depth", "base")).withColumn("dst", F.regexp_replace(F.concat("base", "name"), "^/", ""))
    found = tried.join(packages.select(F.col("location").alias("dst")), "dst")
    return found.groupBy("src", "name").agg(F.max(F.struct("depth", "dst")).alias("x")).select("src", F.col("x.dst").alias("dst"))



def nested_lock_packages(files: DataFrame) -> DataFrame:
    """path, name, version, resolved, integrity, dev, optional, wants of lock files in the nested layout (path, value: the JSON): every entry, copies inside others too, in the order of names, with a depth of 1.

    The nesting has no bound that a schema could state, so the tree is walked in Python, a file at a time, without recursion.
    """
    import json
    from collections.abc import Iterator

    import pyarrow as pa

    schema = "path string, name string, version string, resolved string, integrity string, dev boolean, optional boolean, wants array<string>, depth int"
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.int32())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting = [json.loads(value or "{}").get("dependencies") or {}]
                while waiting:
                    for name, entry in sorted(waiting.pop(0).items()):
                        text = lambda k, e=entry: e[k] if isinstance(e.get(k), str) else None
                        out.append((path, name, text("version") or "", text("resolved"), text("integrity"), entry.get("dev") is True, entry.get("optional") is True, sorted(entry.get("requires") or {}) if isinstance(entry.get("requires"), dict) else [], 1))
                        if isinstance(entry.get("dependencies"), dict):
                            waiting.append(entry["dependencies"])
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    return files.select("path", "value").mapInArrow(run, schema)


def base_name(text):  # noqa: ANN001, ANN201
    """The first name of a requirement, lower case, hyphens as underscores; empty without one."""
    return F.replace(F.lower(F.regexp_extract(text, r"^([a-zA-Z0-9_\-]+)", 1)), F.lit("-"), F.lit("_"))


def requirement_names(files: DataFrame) -> DataFrame:
    """path, name of requirement files (path, value), each name once a file."""
    lines = files.select("path", F.explode(F.split("value", r"\r?\n")).alias("_l")).select("path", F.trim("_l").alias("_l"))
    return lines.filter("_l <> '' AND NOT startswith(_l, '#')").select("path", base_name(F.col("_l")).alias("name")).filter("name <> ''").distinct()


def project_names(files: DataFrame) -> DataFrame:
    """path, name of the dependencies of project files in TOML (path, value); one that is no TOML gives none."""
    import tomllib
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = tomllib.loads(value or "").get("project", {}).get("dependencies", [])
                except tomllib.TOMLDecodeError:
                    continue
                out += [(path, x) for x in found if isinstance(x, str)]
            if out:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], names=["path", "text"])

    rows = files.select("path", "value").mapInArrow(run, "path string, text string")
    return rows.select("path", base_name(F.col("text")).alias("name")).filter("name <> ''").distinct()


TASK = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.StringType()) for n in ("command", "cwd")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("depends_on", "inputs", "outputs")] + [T.StructField("weight", T.IntegerType())]))


def task_manifest(files: DataFrame) -> DataFrame:
    """task, package, command, cwd, depends_on, inputs, outputs, weight of manifests (folder, value: the JSON); '' is the root's folder, any other a workspace.

    A workspace's tasks are package#task, their needs too unless they name a package; their folder is the workspace unless they name one. A weight is 1 at least.
    """
    each = files.select("folder", F.explode(F.from_json("value", T.StructType([T.StructField("tasks", TASK)]))["tasks"]).alias("_n", "t"))
    package = F.when(F.col("folder") != "", F.element_at(F.split("folder", "/"), -1))
    scoped = lambda n: F.when(package.isNull() | n.contains("#"), n).otherwise(F.concat(package, F.lit("#"), n))
    none = F.array().cast("array<string>")
    cwd = F.coalesce("t.cwd", F.lit(""))
    return each.select(scoped(F.col("_n")).alias("task"), package.alias("package"), F.coalesce("t.command", F.lit("")).alias("command"), F.when((cwd == "") & package.isNotNull(), F.col("folder")).otherwise(cwd).alias("cwd"), F.transform(F.coalesce("t.depends_on", none), scoped).alias("depends_on"), F.coalesce("t.inputs", none).alias("inputs"), F.coalesce("t.outputs", none).alias("outputs"), F.greatest(F.lit(1), F.coalesce("t.weight", F.lit(0))).alias("weight"))
