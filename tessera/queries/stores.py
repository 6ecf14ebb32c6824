"""Queries of logs, key-value stores, sessions, transactions and streams on literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import changelog, logs, sessions, transactions
from tessera.queries.base import Rows, query
from tessera.sources import binary, text
from tessera.storage import fresh_dir
from tessera.streaming import replay

LINES = Rows("line long, value string", [(0, "2024-01-01 10:00:00 ERROR disk 17 is full"), (1, "  2024-01-01 10:30:00 error disk 18 is full "), (2, "2024-01-01T11:00:00 INFO started"), (3, "2024-13-01 11:00:00 WARNING odd date"), (4, ""), (5, "no log line"), (6, "2024-01-02 11:59:59 CRITICAL id deadbeef01"), (7, "2024-01-02 10:00:00 DEBUG x")])
_LINE = r"'(?i)^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})\s+(DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+(.*)$'"
_LOG = f"l AS (SELECT line, nullif(upper(regexp_extract(trim(value), {_LINE}, 2)), '') AS level, regexp_extract(trim(value), {_LINE}, 3) AS message, try_strptime(regexp_extract(trim(value), {_LINE}, 1), '%Y-%m-%d %H:%M:%S') AS ts FROM {LINES})"


@query(f"WITH {_LOG} SELECT line, level, CASE WHEN level IS NOT NULL THEN message END AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM l")
def log_parsed(t, spark, d):
    """S1, P1."""
    return text.parsed_log(LINES.frame(spark)).select("line", "level", "message", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"WITH {_LOG} SELECT count(*) AS total, count(level) AS parsed, count(*) - count(level) AS ignored, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM l")
def log_totals(t, spark, d):
    """A2, A3."""
    rows = logs.health(text.parsed_log(LINES.frame(spark)))
    return rows.select("total", "parsed", "ignored", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_ts", "last_ts")))


@query("SELECT * FROM (VALUES (0, 'Application errors were detected.'), (1, 'Critical events require immediate attention.'), (2, '2 lines could not be parsed.'), (3, 'Peak activity occurred around 10:00 with 3 entries.')) t(position, insight)")
def log_insights(t, spark, d):
    """What the counts of the sample say, by hand."""
    return logs.insights(text.parsed_log(LINES.frame(spark)))


WAL = Rows("line long, value string", [(0, '{"op": "SET", "key": "a", "value": "1", "ttl": null, "ts": 10}'), (1, ""), (2, '{"op": "SET", "key": "b", "value": "2", "ttl": 5, "ts": 11}'), (3, '{"op": "DELETE", "key": "a", "ts": 12}'), (4, '{"op": "SET", "key": "c", "va')])


@query(f"SELECT line AS seq, json_extract_string(value, '$.op') AS op, json_extract_string(value, '$.key') AS key, json_extract_string(value, '$.value') AS value, CAST(json_extract_string(value, '$.ttl') AS DOUBLE) AS ttl FROM {WAL} WHERE json_valid(value)")
def wal_scan(t, spark, d):
    """Blank lines are skipped, a torn last one drops (tests hold that one before raises)."""
    return text.change_log(WAL.frame(spark)).select("seq", "op", "key", "value", "ttl")


_RECORDS = [("SET", "a", "1", 0), ("SET", "b", "22", 50), ("DELETE", "a", "", 0), ("SET", "c", "333", 10)]
RECORDS = Rows("seq long, op string, key string, value string, expires_at long", [(i, *r) for i, r in enumerate(_RECORDS)])


@query(f"SELECT seq, op, key, value, expires_at, CAST(sum(22 + 4 + length(key) + length(value)) OVER (ORDER BY seq) AS BIGINT) - (26 + length(key) + length(value)) AS start FROM {RECORDS}")
def record_scan(t, spark, d):
    """Records up to a torn one, and where each begins."""
    raw = b"".join(binary.record(op, k.encode(), v.encode(), e) for op, k, v, e in _RECORDS) + binary.record("SET", b"torn", b"x")[:-3]
    rows = binary.record_log(spark.createDataFrame([("kv", bytearray(raw))], "path string, content binary"))
    return rows.select("seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "expires_at", F.col("offset").alias("start"))


@query(f"WITH l AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, arg_max(expires_at, seq) AS e FROM {RECORDS} GROUP BY key) SELECT key, value FROM l WHERE op = 'SET' AND (e = 0 OR e > 20)")
def record_compaction(t, spark, d):
    """What a compacted log keeps at a time."""
    return changelog.compacted(RECORDS.frame(spark), F.lit(20)).select("key", "value")


SNAPSHOT = Rows("line long, value string", [(0, "a 1"), (1, "  b two words"), (2, ""), (3, "c 3")])
TAIL = Rows("line long, value string", [(0, "PUT a 9"), (1, "DEL c"), (2, ""), (3, "PUT d   new")])


@query("SELECT * FROM (VALUES ('a', '9'), ('b', 'two words'), ('d', 'new')) t(key, value)")
def snapshot_replay(t, spark, d):
    """A snapshot and the log that follows."""
    return changelog.snapshot_and_log(text.snapshot(SNAPSHOT.frame(spark)), text.key_value_log(TAIL.frame(spark)))


OPS = Rows("seq long, op string, key string, value string, ttl double, ts double", [(0, "SET", "old", "x", None, 1.0), (1, "FLUSH", None, None, None, 2.0), (2, "SET", "a", "1", None, 3.0), (3, "SET", "b", "2", 10.0, 4.0), (4, "SET", "c", "3", 1.0, 5.0), (5, "EXPIRE", "a", None, 100.0, 6.0), (6, "SET", "d", "4", None, 7.0), (7, "DELETE", "d", None, None, 8.0), (8, "SET", "e", "5", 0.0, 9.0), (9, "DELETE", "zz", None, None, 9.5), (10, "DELETE", "d", None, None, 9.6)])


def state(spark):
    return changelog.replay(OPS.frame(spark), F.lit(12.0))


@query("SELECT * FROM (VALUES ('a', '1', 106.0::DOUBLE), ('b', '2', 14.0)) t(key, value, expires_at)")
def kv_flush_replay(t, spark, d):
    """K1, W4 with a FLUSH."""
    return state(spark)


ASKED = Rows("position long, op string, key string", [(0, "get", "a"), (1, "get", "c"), (2, "exists", "b"), (3, "exists", "old"), (4, "ttl", "b"), (5, "ttl", "d"), (6, "get", "none")])


@query("SELECT * FROM (VALUES (0::BIGINT, '1'), (1, NULL), (2, 'true'), (3, 'false'), (4, '2.0'), (5, NULL), (6, NULL)) t(position, answer)")
def kv_answers(t, spark, d):
    """Point questions to the replayed state."""
    return changelog.answers(state(spark), ASKED.frame(spark), F.lit(12.0)).select("position", "answer")


@query("SELECT unnest(['a', 'b']) AS key")
def kv_live_keys(t, spark, d):
    """T16."""
    return changelog.live_keys(state(spark), F.lit(12.0))


@query(f"SELECT seq, key FROM (SELECT seq, key, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS before FROM {OPS}) WHERE op = 'DELETE' AND (before IS NULL OR before = 'DELETE')")
def kv_missing_deletes(t, spark, d):
    """K3: deletions of what was not there."""
    return changelog.missing_deletes(OPS.frame(spark).withColumn("expires_at", F.lit(0.0)))


@query(f"SELECT op, count(*) AS n FROM {OPS} GROUP BY op")
def kv_backup(t, spark, d):
    """K6: a log copied to a new place and taken over again."""
    place = fresh_dir(spark, "backup")
    changelog.backup(OPS.frame(spark), place)
    return changelog.restored(spark.read.parquet(place)).groupBy("op").agg(F.count("*").alias("n"))


COMMANDS = Rows("seq long, value string", [(0, "set a 1 2"), (1, "GET a"), (2, "  "), (3, "GET"), (4, "expire a 5"), (5, "EXPIRE a x"), (6, "KEYS"), (7, "nope a"), (8, "KEYS all")])


@query("SELECT * FROM (VALUES (0::BIGINT, 'SET', 'a', '1 2', NULL::DOUBLE, NULL), (1, 'GET', 'a', NULL, NULL, NULL), (2, NULL, NULL, NULL, NULL, 'empty command'), (3, NULL, NULL, NULL, NULL, 'wrong number of arguments'), (4, 'EXPIRE', 'a', NULL, 5.0, NULL), (5, NULL, NULL, NULL, NULL, 'not a number'), (6, 'KEYS', NULL, NULL, NULL, NULL), (7, NULL, NULL, NULL, NULL, 'unknown command'), (8, NULL, NULL, NULL, NULL, 'wrong number of arguments')) t(seq, op, key, value, ttl, error)")
def kv_commands(t, spark, d):
    """The text protocol as a log."""
    return changelog.commands(COMMANDS.frame(spark))


EVENTS = Rows("idx long, type long, method string, path string, status long, body string", [(0, 1, "GET", "/a", 0, ""), (1, 2, "GET", "/a", 200, "one"), (2, 1, "POST", "/b", 0, "in"), (3, 2, "POST", "/b", 500, "two")])


@query(f"SELECT idx, type, method, path, status, body, true AS intact FROM {EVENTS}")
def session_scan(t, spark, d):
    """Events of a session file with a torn tail."""
    raw = b"".join(binary.event(i * 100, kind, method, path, status, {"H": ["v"]}, body.encode()) for i, kind, method, path, status, body in EVENTS.rows)
    rows = binary.session_events(spark.createDataFrame([("s", bytearray(raw + b"\0\0\0\x09abc"))], "path string, content binary"))
    return rows.select(F.col("idx").cast("long").alias("idx"), F.col("type").cast("long").alias("type"), "method", F.col("event_path").alias("path"), F.col("status").cast("long").alias("status"), F.col("body").cast("string").alias("body"), "intact")


FAULTS = Rows("position long, idx long, status long, delay long", [(0, 1, 500, 10), (1, 1, 503, 0), (2, 3, 429, 5)])


@query(f"SELECT e.idx, f.status AS fault_status, f.delay AS fault_delay FROM {EVENTS} e LEFT JOIN (SELECT idx, arg_max(status, position) AS status, arg_max(delay, position) AS delay FROM {FAULTS} GROUP BY idx) f ON e.idx = f.idx")
def session_faults(t, spark, d):
    """J20."""
    return sessions.with_faults(EVENTS.frame(spark), FAULTS.frame(spark)).select("idx", "fault_status", "fault_delay")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM conversations")
def session_offsets(t, spark, d):
    """K7: index and offset of an append stream."""
    rows = t("conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return replay.indexed(rows, "conv_id", "turn", "n").select("conv_id", "turn", F.col("index").alias("place"), F.col("offset").alias("before"))


STATES = Rows("txn string, seq long, status string", [("a", 0, "PLANNED"), ("a", 1, "PREPARED"), ("a", 2, "RUNNING"), ("a", 3, "COMMITTED"), ("b", 0, "PLANNED"), ("b", 1, "ROLLING_BACK"), ("b", 2, "ROLLED_BACK"), ("b", 3, "RUNNING"), ("c", 0, "RECOVERY_FAILED"), ("c", 1, "ROLLING_BACK")])
_ALLOWED = Rows("before string, after string", [(a, b) for a, after in transactions.TRANSITIONS.items() for b in after])


@query(f"SELECT txn, seq, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY txn ORDER BY seq) AS before FROM {STATES}) s WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_ALLOWED} a WHERE a.before = s.before AND a.after = s.status)")
def txn_transition_errors(t, spark, d):
    """K9, W10."""
    return changelog.transition_errors(STATES.frame(spark), _ALLOWED.frame(spark)).select("txn", "seq", "before", "status")


JOURNAL = Rows("sequence long, kind int, payload string", [(1, 1, '{"id":"t1"}'), (2, 2, '{"id":"t1","op":"0"}'), (3, 3, '{"id":"t1","op":"0"}')])


@query(f"SELECT sequence, kind, payload FROM {JOURNAL}")
def txn_journal(t, spark, d):
    """Whole frames of a journal with a torn tail, their checksums and their sequence."""
    import json

    raw = b"".join(transactions.frame(s, k, json.loads(p)) for s, k, p in JOURNAL.rows) + transactions.frame(4, 4, {})[:9]
    return transactions.journal(spark.createDataFrame([("j", bytearray(raw))], "path string, content binary")).select("sequence", "kind", "payload")


INVENTORY = Rows("path string, type string, size long, content string", [("d", "dir", 0, None), ("d/a", "file", 10, "hello a"), ("d/b", "file", 20, "hello b"), ("e", "dir", 0, None), ("e/x", "file", 7, "x"), ("f", "file", 3, "abc")])
STATEMENTS = Rows("txn string, position long, kind string, path string, source string, content string, old string, new string, overwrite boolean", [
    ("t1", 0, "mkdir", "new/sub", None, None, None, None, False), ("t1", 1, "write", "new/sub/file", None, "12345", None, None, False), ("t1", 2, "replace", "f", None, None, "b", "BB", False), ("t1", 3, "move", "new/moved", "d/a", None, None, None, False), ("t1", 4, "copy", "e/x", "d/b", None, None, None, True), ("t1", 5, "mkdir", "e", None, None, None, None, False),
    ("t2", 0, "delete", "d", None, None, None, None, False), ("t2", 1, "write", "d/a", None, "z", None, None, False), ("t2", 2, "mkdir", "never", None, None, None, None, False),
    ("t3", 0, "write", "e/x", None, "new", None, None, False), ("t3", 1, "delete", "e", None, None, None, None, False), ("t4", 0, "replace", "f", None, None, "zzz", "y", False), ("t5", 0, "write", "f", None, "longer", None, None, False), ("t5", 1, "replace", "f", None, None, "a", "b", False),
])
_PLAN = Rows("txn string, position long, effect string, rollback_bytes long, error string", [
    ("t1", 0, "create", 0, None), ("t1", 1, "create", 0, None), ("t1", 2, "modify", 3, None), ("t1", 3, "move", 0, None), ("t1", 4, "overwrite", 7, None), ("t1", 5, "noop", 0, None),
    ("t2", 0, "delete", 30, None), ("t2", 1, None, 0, "the parent is no folder"), ("t3", 0, "modify", 7, None), ("t3", 1, None, 0, "what lies below was changed before"), ("t4", 0, None, 0, "the text to replace is not there"), ("t5", 0, "modify", 3, None), ("t5", 1, None, 0, "several statements change one target"),
])


@query(f"SELECT txn, position, effect, rollback_bytes, error FROM {_PLAN}")
def txn_plans(t, spark, d):
    """Each statement against what the earlier ones leave, by hand."""
    return transactions.planned(STATEMENTS.frame(spark), INVENTORY.frame(spark))


@query(f"SELECT txn, {', '.join(f'count(*) FILTER (effect = {chr(39)}{e}{chr(39)}) AS {chr(34)}{e}{chr(34)}' for e in transactions.EFFECTS)}, CAST(sum(rollback_bytes) AS BIGINT) AS rollback_bytes, count(error) = 0 AS safe FROM {_PLAN} GROUP BY txn".replace('"create"', "created").replace('"delete"', "deleted").replace('"', ""))
def txn_plan_summary(t, spark, d):
    """A25."""
    return transactions.plan_summary(transactions.planned(STATEMENTS.frame(spark), INVENTORY.frame(spark))).withColumnsRenamed({"create": "created", "delete": "deleted"})


PROGRAM = Rows("program string, position long, name string, status string", [("p", 0, "a", "COMMITTED"), ("p", 1, "b", "ROLLED_BACK"), ("p", 2, "c", "COMMITTED"), ("p", 3, "d", "PLANNED"), ("q", 0, "x", "COMMITTED"), ("q", 1, "y", "COMMITTED")])


@query(f"SELECT program, name, CASE WHEN EXISTS (SELECT 1 FROM {PROGRAM} b WHERE b.program = a.program AND b.position < a.position AND b.status <> 'COMMITTED') THEN 'SKIPPED' ELSE status END AS status FROM {PROGRAM} a")
def txn_program(t, spark, d):
    """K13."""
    return transactions.program(PROGRAM.frame(spark)).select("program", "name", "status")


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS op, arg_max(CAST(value AS DOUBLE), event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id) SELECT user_id AS key, CASE WHEN op <> 'error' THEN round(value, 4) END AS value, seq FROM l")
def stream_latest(t, spark, d):
    """K5 as a stream: each key's newest value, a running aggregate."""
    stream = replay.file_stream(spark, d, t("events"), "events.parquet")
    changes = stream.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("SET").alias("op"), F.col("user_id").alias("key"), F.round("value", 4).alias("value"))
    return replay.newest_updates(replay.drained(replay.latest_values(changes), "update", "latest"), "key")
