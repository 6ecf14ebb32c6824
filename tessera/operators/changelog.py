"""Change-log replay: last write wins, expiry, flush, compaction. Ordered operations (seq, op, key, ...) become the state at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import written


def expired(expires_at: Column, as_of: Column) -> Column:
    """0 or null never expires."""
    return F.coalesce((expires_at != 0) & (as_of >= expires_at), F.lit(False))


def latest(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The last operation of each key, by a partial aggregate: a hot key is one row a task, not a sorted group."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("_x")).select(key, "_x.*")


def live(log: DataFrame, as_of: Column, key: str = "key", order: str = "seq", deletes: tuple[str, ...] = ("DELETE", "DEL")) -> DataFrame:
    """Keys whose last operation is no deletion and has not expired (column expires_at, if there is one)."""
    out = latest(log, key, order).filter(~F.col("op").isin(*deletes))
    return out.filter(~expired(F.col("expires_at"), as_of)) if "expires_at" in log.columns else out


def replay(log: DataFrame, as_of: Column) -> DataFrame:
    """key, value, expires_at after all operations SET, DELETE, EXPIRE (seq, op, key, value, ttl, ts), FLUSH clearing all before it.

    Expiry is judged at as_of for each operation: a lifetime that has ended by then drops the key although a later EXPIRE
    had prolonged it. In plain aggregates: the last FLUSH, the last SET or DELETE of a key after it, and the
    EXPIREs after that.
    """
    flush = log.filter("op = 'FLUSH'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_flush"))
    rows = log.filter("op <> 'FLUSH'").crossJoin(flush).filter("seq > _flush").drop("_flush")
    base = latest(rows.filter("op IN ('SET', 'DELETE')")).filter("op = 'SET'").select("key", F.col("seq").alias("_at"), "value", F.col("ttl").alias("_ttl"), (F.col("ts") + F.col("ttl")).alias("_until"))
    base = base.filter("_ttl IS NULL OR _ttl > 0").filter(F.col("_until").isNull() | (F.col("_until") > as_of))
    until = F.col("ts") + F.col("ttl")
    later = rows.filter("op = 'EXPIRE' AND ttl IS NOT NULL").join(base.select("key", "_at"), "key").filter("seq > _at").groupBy("key").agg(F.max_by(until, "seq").alias("_new"), F.bool_or((F.col("ttl") <= 0) | (until <= as_of)).alias("_dead"))
    return base.join(later, "key", "left").filter(~F.coalesce("_dead", F.lit(False))).select("key", "value", F.coalesce("_new", "_until").alias("expires_at"))


def remaining(state: DataFrame, as_of: Column) -> DataFrame:
    """key, ttl: seconds left, -1 for keys that do not expire."""
    return state.select("key", F.when(F.col("expires_at").isNull(), F.lit(-1.0)).otherwise(F.col("expires_at") - as_of).alias("ttl"))


def stats(log: DataFrame, as_of: Column) -> DataFrame:
    """live, expired: keys by the state of their last operation."""
    last = latest(log).filter("op <> 'DELETE'")
    gone = expired(F.col("expires_at"), as_of)
    return last.agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("expired"))


def compacted(log: DataFrame, as_of: Column) -> DataFrame:
    """The log with one operation a live key: deletions and expired keys are gone. To be written to a new place."""
    return live(log, as_of).select(*log.columns)


def snapshot_and_log(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """key, value after a snapshot and the log that follows it (both: seq, source, op, key, value, the log's source being the larger)."""
    rows = snapshot.unionByName(log).withColumn("_order", F.struct("source", "seq"))
    return latest(rows, order="_order").filter("op = 'PUT'").select("key", "value")


def evicted(entries: DataFrame, key: str, order: str, size: str, budget: Column) -> DataFrame:
    """The entries that go, oldest first, until the rest fits the budget.

    The running sum is taken in two steps: within ranges of the order, and over the ranges' sums. So no task sees all rows.
    """
    ranged = written(entries.select(*dict.fromkeys((key, order, size))).repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum(size).alias("_sum")).withColumn("_before", F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum"))
    total = entries.agg(F.sum(size).alias("_all"))
    inner = F.sum(size).over(Window.partitionBy("_part").orderBy(order, key)) - F.col(size)
    return ranged.withColumn("_inner", inner).join(sums, "_part").crossJoin(total).filter(F.col("_all") - F.col("_before") - F.col("_inner") > budget).select(*dict.fromkeys((key, order, size)))


def transition_errors(rows: DataFrame, allowed: DataFrame, key: str = "txn") -> DataFrame:
    """Rows (key, seq, status) whose status may not follow the one before (allowed: before, after)."""
    seen = rows.withColumn("before", F.lag("status").over(Window.partitionBy(key).orderBy("seq")))
    return seen.filter("before IS NOT NULL").join(allowed.select("before", F.col("after").alias("status")), ["before", "status"], "left_anti")


def sequence_gaps(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key, seq, before where a number does not follow the one before."""
    before = F.lag(seq).over(Window.partitionBy(key).orderBy(seq))
    return rows.select(key, seq, before.alias("before")).filter(F.col(seq) != F.col("before") + 1)


def answers(state: DataFrame, asked: DataFrame, as_of: Column) -> DataFrame:
    """asked (position, op, key) with answer, as text, from a replayed state (key, value, expires_at): get (null if there is none), exists, ttl (-1 without an end, null if there is none)."""
    there = state.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).select("key", F.lit(True).alias("_t"), F.col("value").alias("_v"), F.col("expires_at").alias("_e"))
    found = F.coalesce("_t", F.lit(False))
    left = F.when(found, F.when(F.col("_e").isNull(), F.lit(-1.0)).otherwise(F.col("_e") - as_of))
    answer = F.when(F.col("op") == "get", F.col("_v")).when(F.col("op") == "exists", found.cast("string")).when(F.col("op") == "ttl", left.cast("string"))
    return asked.join(there, "key", "left").select(*asked.columns, answer.alias("answer"))


def live_keys(state: DataFrame, as_of: Column) -> DataFrame:
    """key of what has not expired, in order."""
    return state.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).select("key").orderBy("key")


def missing_deletes(log: DataFrame) -> DataFrame:
    """seq, key of deletions of keys that were not there: the operation before was none, or a deletion too, or had expired (column ts: the time of an operation)."""
    by = Window.partitionBy("key").orderBy("seq")
    before = log.select("seq", "key", "op", "ts", F.lag("op").over(by).alias("_o"), F.lag("expires_at").over(by).alias("_e"))
    gone = F.col("_o").isNull() | (F.col("_o") == "DELETE") | expired(F.col("_e"), F.col("ts"))
    return before.filter((F.col("op") == "DELETE") & gone).select("seq", "key")


def backup(log: DataFrame, path: str) -> None:
    """Copies a log; raises where there is something already."""
    log.write.mode("errorifexists").parquet(path)


def restored(log: DataFrame) -> DataFrame:
    """A log that is to be taken over; raises if its first record is no valid operation."""
    first = log.orderBy("seq").select("op").first()
    if first is None or first.op not in ("SET", "DELETE", "EXPIRE", "FLUSH"):
        raise ValueError("the first record is no operation")
    return log


#: The commands of the text protocol, with the least and the most words after the verb.
VERBS = {"SET": (2, None), "GET": (1, 1), "DELETE": (1, 1), "EXISTS": (1, 1), "EXPIRE": (2, 2), "TTL": (1, 1), "KEYS": (0, 0), "FLUSH": (0, 0), "PING": (0, 0), "STATS": (0, 0)}


def commands(lines: DataFrame) -> DataFrame:
    """seq, op, key, value, ttl, error of command lines (seq, value): a verb, a key, the rest as value. The verb's case counts for nothing."""
    line = F.trim("value")
    op, words = F.upper(F.regexp_extract(line, r"^(\S+)", 1)), F.size(F.split(line, r"\s+")) - 1
    fits = F.lit(False)
    for verb, (least, most) in VERBS.items():
        fits = fits | ((op == verb) & (words >= least) & (F.lit(True) if most is None else words <= most))
    known = op.isin(list(VERBS))
    key, rest = F.regexp_extract(line, r"^\S+\s+(\S+)", 1), F.regexp_extract(line, r"^\S+\s+\S+\s+(.*)$", 1)
    error = F.when(line == "", "empty command").when(~known, "unknown command").when(~fits, "wrong number of arguments").when((op == "EXPIRE") & rest.try_cast("double").isNull(), "not a number")
    good = error.isNull()
    return lines.select("seq", F.when(good, op).alias("op"), F.when(good & (key != ""), key).alias("key"), F.when(good & (op == "SET"), rest).alias("value"), F.when(good & (op == "EXPIRE"), rest.try_cast("double")).alias("ttl"), error.alias("error"))
