import math

import pytest

from tessera.operators import search


def docs(spark):
    return spark.createDataFrame([("a", "red apple red"), ("b", "green apple"), ("c", "blue sky"), ("d", None)], "id string, body string")


def test_bm25(spark):
    got = {r.id: r.score for r in search.bm25(docs(spark), "id", "body", "red apple").collect()}
    n, avg = 4, 7 / 4
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda f, size: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / max(avg, 1)))
    assert got == {"a": pytest.approx(idf(1) * part(2, 3) + idf(2) * part(1, 3)), "b": pytest.approx(idf(2) * part(1, 2))}


def test_bm25_counts_a_repeated_term_twice(spark):
    once = search.bm25(docs(spark), "id", "body", "sky").first().score
    assert search.bm25(docs(spark), "id", "body", "sky sky").first().score == pytest.approx(2 * once)


def test_bm25_empty(spark):
    assert search.bm25(docs(spark), "id", "body", "the").count() == 0
    assert search.bm25(docs(spark), "id", "body", "nowhere").count() == 0
    assert search.bm25(docs(spark).limit(0), "id", "body", "sky").count() == 0


def test_scaled_before_tests_go(spark):
    hits = spark.createDataFrame([("t", 4.0), ("x", 2.0), ("__y__", 3.0)], "id string, score double")
    symbols = spark.createDataFrame([("t", "t", 0.0, "UNKNOWN", False, True), ("x", "x", 1.0, "PROVEN", False, False), ("__y__", "__y__", 0.0, "INFERRED", True, False)], "id string, name string, rank double, badge string, stale boolean, is_test boolean")
    got = {r.id: r.score for r in search.blended(hits, symbols, "id").collect()}
    assert got == {"x": pytest.approx(0.0 + 0.2 + 0.2), "__y__": pytest.approx(0.6 * 0.25 + 0.2 * 0.65 / 2)}
    assert {r.score for r in search.scaled(hits.limit(1)).collect()} == {1.0}
