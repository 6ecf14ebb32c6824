import datetime

from tessera.operators import logs
from tessera.sources.text import parsed_log

LINES = [
    "2024-01-02 10:00:00 INFO started",
    "2024-01-02 10:05:00 warning slow 1200 ms",
    "2024-01-02 11:00:00 ERROR no route for user 101",
    "2024-01-02 11:30:00 ERROR no route for user 102",
    "2024-01-02 12:00:00 CRITICAL disk deadbeef01 is full",
    "2024-01-02T12:30:00 INFO with a T",
    "2024-13-02 12:30:00 INFO month thirteen",
    "not a log line",
    "",
]


def lines(spark):
    return parsed_log(spark.createDataFrame([(x,) for x in LINES], "value string"))


def test_levels_and_times(spark):
    rows = lines(spark).collect()
    assert [r.level for r in rows] == ["INFO", "WARNING", "ERROR", "ERROR", "CRITICAL", "INFO", "INFO", None, None]
    assert rows[0].ts == datetime.datetime(2024, 1, 2, 10)
    assert rows[5].ts is None and rows[6].ts is None and rows[5].message == "with a T"


def test_health(spark):
    row = logs.health(lines(spark)).first()
    assert (row.total, row.parsed, row.ignored, row.errors, row.critical, row.warnings) == (9, 7, 2, 3, 1, 1)
    assert (row.score, row.status) == (100 - 21 - 12 - 2, "STABLE WITH WARNINGS")


def test_patterns_fold_numbers_before_ids(spark):
    from pyspark.sql import functions as F

    found = logs.error_patterns(lines(spark).withColumn("_n", F.monotonically_increasing_id()), F.col("_n")).collect()
    assert [(r.pattern, r.n) for r in found] == [("no route for user <number>", 2), ("disk <id> is full", 1)]


def test_insights(spark):
    said = [r.insight for r in logs.insights(lines(spark)).orderBy("position").collect()]
    assert said == ["Application errors were detected.", "Critical events require immediate attention.", "2 lines could not be parsed.", "Peak activity occurred around 11:00 with 2 entries."] or said[3].startswith("Peak activity occurred around 10:00 with 2")


def test_no_lines(spark):
    assert logs.health(lines(spark).limit(0)).first().score == 100
