"""Folders as tables. listing() walks a file system by rounds of folders, each listed where a task runs, and doesn't enter what is pruned; scans are filters on its rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.paths import PathQuery
from tessera.storage import written

ENTRY = "path string, name string, is_dir boolean, size long, modified timestamp, error string"
#: Folders that scans do not enter.
SOURCE_IGNORED = ["node_modules", ".git", ".svn", ".hg", "dist", "build", "coverage", ".next", ".cache"]
PROJECT_IGNORED = [".git", "venv", ".venv", "__pycache__", "node_modules"]
TREE_IGNORED = ["__pycache__"]


class TooManyFiles(ValueError):
    """A walk met more files than it may."""


def listing(spark: SparkSession, root: str, pruned: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """ENTRY of all that lies below a folder (a URI), paths relative to it. Folders with a pruned name are left out whole; one that can't be read has an error."""
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows: list[tuple] = []
            for folder in batch.column(0).to_pylist():
                store, top = fs.FileSystem.from_uri(f"{base}/{folder}".rstrip("/"))
                try:
                    found = store.get_file_info(fs.FileSelector(top))
                except OSError as e:
                    rows.append((folder, folder.rpartition("/")[2], True, None, None, str(e)))
                    continue
                for info in found:
                    is_dir = info.type == fs.FileType.Directory
                    if not (is_dir and info.base_name in pruned):
                        rows.append((f"{folder}/{info.base_name}".lstrip("/"), info.base_name, is_dir, None if is_dir else info.size, info.mtime, None))
            if rows:
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["path", "name", "is_dir", "size", "modified", "error"])

    out, folders = None, spark.createDataFrame([("",)], "path string")
    while True:
        found = written(folders.mapInArrow(run, ENTRY), "listing")
        out = found if out is None else out.unionByName(found)
        folders = found.filter("is_dir AND error IS NULL").select("path")
        if folders.isEmpty():
            return out
        folders = folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def extension(name: Column) -> Column:
    """The last dot and what follows, in lower case; none for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def files_of(entries: DataFrame) -> DataFrame:
    return entries.filter("NOT is_dir")


def inside(path: Column, names: list[str]) -> Column:
    """Whether a folder of the path has one of the names."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), F.array(*map(F.lit, names)))


def source_files(entries: DataFrame, extensions: tuple[str, ...] = (".js",), ignored: tuple[str, ...] = ()) -> DataFrame:
    """path of source files; case of the extension counts for nothing."""
    return files_of(entries).filter(extension(F.col("name")).isin([e.lower() for e in extensions]) & ~inside(F.col("path"), [*SOURCE_IGNORED, *ignored])).select("path")


def python_project(entries: DataFrame) -> DataFrame:
    """path, kind (python, requirements, pyproject), module (the project's own that a Python file belongs to: its first folder, or its stem at the root)."""
    name = F.col("name")
    kind = F.when(name.rlike(r"^.+\.py$"), "python").when(name == "requirements.txt", "requirements").when(name == "pyproject.toml", "pyproject")
    rows = files_of(entries).filter(~inside(F.col("path"), PROJECT_IGNORED)).withColumn("kind", kind).filter("kind IS NOT NULL")
    parts = F.split("path", "/")
    module = F.when(F.size(parts) > 1, parts[0]).when(name != "__init__.py", F.regexp_replace(name, r"\.py$", ""))
    return rows.select("path", "kind", F.when(F.col("kind") == "python", module).alias("module"))


def python_tree(entries: DataFrame) -> DataFrame:
    """path of Python files that lie in no folder, and are none, whose name begins with a dot."""
    return files_of(entries).filter(F.col("name").endswith(".py") & ~F.col("path").rlike(r"(?:^|/)\.") & ~inside(F.col("path"), TREE_IGNORED)).select("path").orderBy("path")


def guarded(entries: DataFrame, most: int) -> DataFrame:
    """path, size of the files, in order; raises if there are more than `most`."""
    files = files_of(entries)
    if (n := files.count()) > most:
        raise TooManyFiles(f"{n} files, at most {most} are allowed")
    return files.select("path", "size").orderBy("path")


def matching(entries: DataFrame, query: PathQuery, strict: bool = False) -> DataFrame:
    """Entries that fit a path query, with type (file or dir). strict: raises if a folder could not be read."""
    if strict and not (bad := entries.filter("error IS NOT NULL")).isEmpty():
        raise OSError(bad.first().error)
    return query.run(entries.withColumn("type", F.when(F.col("is_dir"), "dir").otherwise("file")), "path", "type")


def globbed(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """path of the files that fit any pattern, each once, in order."""
    return PathQuery(patterns, hidden=True).run(files_of(entries)).select("path").dropDuplicates().orderBy("path")


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """path, content of listed files, read where a task runs."""
    base = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(f"{base}/{path}")
                with store.open_input_file(at) as file:
                    yield pa.record_batch([pa.array([path]), pa.array([file.read()], pa.binary())], names=["path", "content"])

    return files.select("path").mapInArrow(run, "path string, content binary")
