import pytest
from pyspark.sql import functions as F

from tessera.operators import changelog
from tessera.sources import binary


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_record_log(spark):
    good = binary.record("SET", b"a", b"1") + binary.record("SET", b"b", b"2", 50) + binary.record("DELETE", b"a")
    damaged = bytearray(binary.record("SET", b"c", b"3"))
    damaged[-1] ^= 1
    for tail in (b"", good[:10], bytes(damaged) + binary.record("SET", b"d", b"4")):
        rows = binary.record_log(files(spark, good + tail)).orderBy("seq").collect()
        assert [(r.op, bytes(r.key), bytes(r.value), r.expires_at) for r in rows] == [("SET", b"a", b"1", 0), ("SET", b"b", b"2", 50), ("DELETE", b"a", b"", 0)]
    log = binary.record_log(files(spark, good))
    assert [bytes(r.key) for r in changelog.live(log, F.lit(49)).collect()] == [b"b"]
    assert changelog.live(log, F.lit(50)).count() == 0
    assert binary.record_log(files(spark, b"")).count() == 0


def test_session_events(spark):
    data = binary.event(5, 1, "GET", "/a", 0, {"X": ["1", "2"]}, b"") + binary.event(9, 2, "GET", "/a", 200, {}, b"ok")
    rows = binary.session_events(files(spark, data + data[:7])).orderBy("idx").collect()
    assert [(r.idx, r.offset_ns, r.type, r.method, r.event_path, r.status, bytes(r.body), r.intact) for r in rows] == [(0, 5, 1, "GET", "/a", 0, b"", True), (1, 9, 2, "GET", "/a", 200, b"ok", True)]
    assert rows[0].headers == {"X": ["1", "2"]}
    with pytest.raises(Exception, match="damaged session"):
        binary.session_events(files(spark, data[:7])).collect()


LOCK = b"""version = 3
[[package]]
name = "own"
version = "0.1.0"
dependencies = ["a", "b 2.0.0", "gone"]
[[package]]
name = "a"
version = "1.0.0"
source = "registry+x"
checksum = "c"
dependencies = ["b"]
[[package]]
name = "b"
version = "1.0.0"
source = "registry+x"
[[package]]
name = "b"
version = "2.0.0"
source = "git+x"
"""


def test_toml_lock(spark):
    packages = binary.toml_lock_packages(files(spark, LOCK))
    assert sorted((r.name, r.version, r.link) for r in packages.collect()) == [("a", "1.0.0", False), ("b", "1.0.0", False), ("b", "2.0.0", False), ("own", "0.1.0", True)]
    assert sorted((r.src, r.dst) for r in binary.toml_lock_edges(packages).collect()) == [("own 0.1.0", "a 1.0.0"), ("own 0.1.0", "b 2.0.0")]


def test_file_types(spark):
    cases = [(b"\xff\xd8\xff\xe0", "a.jpg", "jpeg"), (b"PK\x03\x04", "b", "zip"), (b"\0" * 257 + b"ustar" + b"\0" * 10, "c", "tar"), (b"  <svg>", "d", "svg"), (b"<?xml ?><a/>", "e", "xml"), (b"<!DOCTYPE html>", "f", "html"), (b"{}", "g.json", "json"), (b"", "h", "text"), (b"plain\n", "i", "text"), (b"a\x00b", "j", "binary"), (b"\x01\x02\x03abc", "k", "binary"), (b"MZ", "l", "pe-executable")]
    frame = spark.createDataFrame([(p, bytearray(c)) for c, p, _ in cases], "path string, content binary")
    got = {r.path: r.t for r in frame.select("path", binary.file_type(F.col("content"), F.col("path")).alias("t")).collect()}
    assert got == {p: t for _, p, t in cases}
