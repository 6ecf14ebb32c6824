import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize("value, want", [("rnodern", "modem"), ("vvord", "word"), ("p-y_t.hon", "python"), ("he110", "hello"), ("l0dash", "lodash")])
def test_skeleton(spark, value, want):
    assert one(spark, value, T.skeleton) == want


def test_tokens(spark):
    assert one(spark, "getUserName the HTTPServer_port a1 x", T.search_tokens) == ["get", "user", "name", "httpserver", "port", "a1"]
    assert one(spark, None, T.search_tokens) is None


def test_entropy(spark):
    assert one(spark, "aabb", T.entropy) == pytest.approx(1.0)
    assert one(spark, "abcdefgh", T.entropy) == pytest.approx(3.0)
    assert one(spark, "", T.entropy) == 0


@pytest.mark.parametrize("value, want", [("abc", "***"), ("abcdefg", "ab*****"), ("abcdefghijkl", "abcd********"), ("ghp_" + "a" * 36, "ghp_" + "*" * 36), ("", "[REDACTED]")])
def test_redacted(spark, value, want):
    assert one(spark, value, T.redacted) == want


@pytest.mark.parametrize("value, want", [("10", 10), ("1.5 kB", 1500), ("2MiB", 2 << 20), ("3g", 3 * 10**9), ("x", None)])
def test_byte_size(spark, value, want):
    assert one(spark, value, T.byte_size) == want


@pytest.mark.parametrize("value, want", [("90", 90), ("5m", 300), ("1.5h", 5400), ("1d", 86400), ("1w", None)])
def test_duration(spark, value, want):
    assert one(spark, value, T.duration_seconds) == want


def test_password(spark):
    assert one(spark, "", T.password_score) == 0
    assert one(spark, None, T.password_score) == 0
    short = max(0, min(100, math.floor(round(5 * math.log2(26), 2) * 1.25 + 0.5) - 30 - 30))
    assert one(spark, "abcde", T.password_score) == short
    assert one(spark, "aaaaaaaa", T.password_score) == 0
    assert one(spark, "Tr0ub4dor&3xKq!zLw9#", T.password_score) == 100
    assert one(spark, "x", lambda c: T.password_tier(F.lit(85))) == "STRONG"


def test_binary(spark):
    assert one(spark, "\x00\x01ab", T.looks_binary) is True
    assert one(spark, "plain\ttext\n", T.looks_binary) is False


def test_package_names(spark):
    assert one(spark, "My_Pkg..x", T.package_name) == "my-pkg-x"
    assert one(spark, "@a/b", T.name_scope) == "a"
    assert one(spark, "b", T.name_scope) is None
    assert one(spark, "@a/b", T.bare_name) == "b"
