"""Log triage: counts, health, status and insights of parsed log lines (ts, level, message; level null where a line did not parse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import log_pattern

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def level_counts(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("level").isNotNull()).groupBy("level").agg(F.count("*").alias("n"))


def hour_counts(lines: DataFrame) -> DataFrame:
    """Counts by hour of the day; lines without a readable time are left out."""
    return lines.filter(F.col("ts").isNotNull()).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def busiest_hours(lines: DataFrame, most: int = 5) -> DataFrame:
    return hour_counts(lines).orderBy(F.desc("n"), "hour").limit(most)


def error_patterns(lines: DataFrame, order: Column, most: int = 5) -> DataFrame:
    """The most common message patterns of ERROR and CRITICAL lines; ties in the order of first sight."""
    errors = lines.filter(F.col("level").isin("ERROR", "CRITICAL")).select(log_pattern(F.col("message")).alias("pattern"), order.alias("_o"))
    counts = errors.groupBy("pattern").agg(F.count("*").alias("n"), F.min("_o").alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", "pattern").limit(most).select("pattern", "n")


def health_score(errors: Column, critical: Column, warnings: Column) -> Column:
    """errors: ERROR and CRITICAL lines together."""
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 7 * errors - 12 * critical - 2 * warnings))


def status(score: Column) -> Column:
    return F.when(score >= 85, "HEALTHY").when(score >= 65, "STABLE WITH WARNINGS").when(score >= 40, "NEEDS ATTENTION").otherwise("CRITICAL")


def health(lines: DataFrame, *by: str) -> DataFrame:
    """by..., total, parsed, ignored, errors, critical, warnings, first_ts, last_ts, score, status: a row for each key, or one."""
    is_level = lambda *x: F.count_if(F.col("level").isin(*x))
    counts = lines.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count("level").alias("parsed"),
        F.count_if(F.col("level").isNull()).alias("ignored"),
        is_level("ERROR", "CRITICAL").alias("errors"),
        is_level("CRITICAL").alias("critical"),
        is_level("WARNING").alias("warnings"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    scored = counts.withColumn("score", health_score(F.col("errors"), F.col("critical"), F.col("warnings")))
    return scored.withColumn("status", status(F.col("score")))


def insights(lines: DataFrame) -> DataFrame:
    """position, insight: what the counts say, in a fixed order."""
    one = health(lines)
    peak = hour_counts(lines).agg(F.max(F.struct("n", (-F.col("hour")).alias("h"))).alias("peak"))
    errors = F.col("errors")
    said = F.array(
        F.when(errors == 0, "No application errors detected.").when(errors >= 5, "High error activity detected. Immediate investigation is recommended.").otherwise("Application errors were detected."),
        F.when(F.col("critical") > 0, "Critical events require immediate attention."),
        F.when(F.col("warnings") >= 5, "Frequent warnings indicate possible instability."),
        F.when(F.col("ignored") > 0, F.concat(F.col("ignored"), F.lit(" lines could not be parsed."))),
        F.when(F.col("peak").isNotNull(), F.format_string("Peak activity occurred around %02d:00 with %d entries.", -F.col("peak.h"), F.col("peak.n"))),
        F.when(F.col("score") >= 85, "Overall log health looks good."),
    )
    return one.join(peak).select(F.posexplode(F.array_compact(said)).alias("position", "insight"))
