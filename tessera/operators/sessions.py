"""Recorded sessions: pairing requests with responses, and replaying them in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired(events: DataFrame, session: str, order: str, is_request: Column, is_response: Column, value: str) -> DataFrame:
    """session, request, response (their order), request_value, response_value of each request whose next event is a response."""
    by = Window.partitionBy(session).orderBy(order)
    rows = events.select(session, F.col(order).alias("request"), is_request.alias("_q"), F.lead(order).over(by).alias("response"), F.lead(is_response).over(by).alias("_r"), F.col(value).alias("request_value"), F.lead(value).over(by).alias("response_value"))
    return rows.filter("_q AND _r").drop("_q", "_r")


def nth_answers(asked: DataFrame, recorded: DataFrame, key: list[str], order: str, answer: str) -> DataFrame:
    """The nth request for a key gets its nth recorded answer; `answer` is null where they are used up."""
    by = Window.partitionBy(*key).orderBy(order)
    a = asked.withColumn("n", F.row_number().over(by))
    r = recorded.select(*key, F.row_number().over(by).alias("n"), F.col(answer).alias("answer"))
    return a.join(r, [*key, "n"], "left")


def with_faults(events: DataFrame, faults: DataFrame, index: str = "idx") -> DataFrame:
    """events with the status and delay of the last fault rule (position, idx, status, delay) for their index."""
    last = faults.groupBy(index).agg(F.max_by(F.struct("status", "delay"), "position").alias("_f"))
    return events.join(last, index, "left").withColumns({"fault_status": F.col("_f.status"), "fault_delay": F.col("_f.delay")}).drop("_f")
