"""What scans, sinks, inspectors and journals refuse, and what their queries can't show."""

import io
import struct
import zipfile

import pytest
from pyspark.errors import AnalysisException, PythonException

from tessera import sinks
from tessera.operators import changelog, inspect, transactions
from tessera.plans.paths import PathQuery
from tessera.sources import scan
from tessera.sources.text import numbered
from tessera.storage import discard, written


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_scans_refuse(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.py").write_text("x")
    listed = scan.listing(spark, f"file://{tmp_path}")
    assert scan.guarded(listed, 3).count() == 3
    with pytest.raises(scan.TooManyFiles):
        scan.guarded(listed, 2)
    bad = scan.listing(spark, f"file://{tmp_path}/none")
    assert bad.filter("error IS NOT NULL").count() == 1
    with pytest.raises(OSError, match="none"):
        scan.matching(bad, PathQuery(["**"]), strict=True)


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert rows(numbered(spark, str(tmp_path / "log")), "line", "value") == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bundles_are_the_same_bytes(spark):
    files = spark.createDataFrame([(f"f{i}", bytearray(b"x" * i)) for i in range(20)], "path string, content binary")
    first, again = (bytes(sinks.bundle(files.repartition(n)).first().content) for n in (1, 7))
    assert first == again
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for i in range(inspect.MOST_ENTRIES + 1):
            archive.writestr(f"{i}", b"")
    with pytest.raises(PythonException, match="limits"):
        inspect.zip_entries(spark.createDataFrame([("b.zip", bytearray(out.getvalue()))], "path string, content binary")).collect()


def test_positions_of_errors(spark):
    texts = spark.createDataFrame([("a", '{"x": 1,\n "y": }'), ("b", "[1]"), ("c", None)], "path string, body string")
    assert [r[:3] for r in rows(inspect.json_error(texts), "path", "line", "column")] == [("a", 2, 7), ("c", 1, 1)]
    csvs = spark.createDataFrame([("q", 'a,"b,c"\n"x\ny",z\n'), ("bad", 'a,"b\n')], "path string, body string")
    assert rows(inspect.csv_widths(csvs), "path", "width", "n") == [("bad", None, 1), ("q", 2, 2)]


def test_journals_refuse(spark):
    frames = [transactions.frame(i + 1, 1, {"i": i}) for i in range(3)]
    read = lambda data: transactions.journal(spark.createDataFrame([("j", bytearray(data))], "path string, content binary")).collect()
    assert len(read(b"".join(frames))) == 3 and len(read(b"".join(frames)[:-1])) == 2
    for data in (b"", frames[0][:10], b"XXXX" + frames[0][4:], frames[0] + frames[2], frames[0][:-1] + bytes([frames[0][-1] ^ 1])):
        with pytest.raises(Exception, match="whole frame|no journal frame|sequence|checksum"):
            read(data)
    assert transactions.castagnoli(b"123456789") == 0xE3069283 and struct.calcsize(transactions.FRAME.format) == 20


def test_backups_refuse(spark, tmp_path):
    log = spark.createDataFrame([(1, "SET"), (2, "DELETE")], "seq long, op string")
    changelog.backup(log, str(tmp_path / "b"))
    with pytest.raises(AnalysisException):
        changelog.backup(log, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        changelog.restored(log.filter("seq > 5"))
    with pytest.raises(ValueError):
        changelog.restored(spark.createDataFrame([(0, "nope")], "seq long, op string"))


def test_conditions_need_a_file(spark):
    asked = spark.createDataFrame([("contains", "d", "x")], "kind string, path string, value string")
    there = spark.createDataFrame([("d", "dir", None)], "path string, type string, content binary")
    with pytest.raises(Exception, match="regular file"):
        transactions.conditions(asked, there).collect()


def test_tables_are_deleted(spark):
    table = written(spark.range(3).toDF("x"), "gone")
    assert table.count() == 3
    discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.written_to)
