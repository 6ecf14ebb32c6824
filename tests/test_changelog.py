import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import changelog
from tessera.sources.text import change_log, key_value_log, snapshot

LOG = "seq long, op string, key string, value string, ttl double, ts double"


def fold(rows, now):
    """The operations one by one."""
    state = {}
    for _, op, key, value, ttl, ts in rows:
        if op == "FLUSH":
            state = {}
        elif op == "DELETE":
            state.pop(key, None)
        elif op == "SET":
            state.pop(key, None)
            if ttl is None:
                state[key] = (value, None)
            elif ttl > 0 and ts + ttl > now:
                state[key] = (value, ts + ttl)
        elif key in state and ttl is not None:
            if ttl <= 0 or ts + ttl <= now:
                del state[key]
            else:
                state[key] = (state[key][0], ts + ttl)
    return state


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["SET", "SET", "EXPIRE", "EXPIRE", "DELETE", "FLUSH" if rng.random() < 0.2 else "SET"]), rng.choice("abcdefgh"), str(i), rng.choice([None, -1.0, 5.0, 50.0, 100.0]), float(i)) for i in range(60)]
    got = {r.key: (r.value, r.expires_at) for r in changelog.replay(spark.createDataFrame(rows, LOG), F.lit(70.0)).collect()}
    assert got == fold(rows, 70.0)


def test_latest_live_stats_compaction(spark):
    log = spark.createDataFrame([(1, "SET", "a", "1", 0.0), (2, "SET", "a", "2", 0.0), (3, "SET", "b", "3", 10.0), (4, "SET", "c", "4", 99.0), (5, "DELETE", "c", None, 0.0), (6, "SET", "d", "5", 60.0)], "seq long, op string, key string, value string, expires_at double")
    now = F.lit(50.0)
    assert {r.key: r.value for r in changelog.live(log, now).collect()} == {"a": "2", "d": "5"}
    assert tuple(changelog.stats(log, now).first()) == (2, 1)
    small = changelog.compacted(log, now)
    assert sorted(map(tuple, changelog.live(small, now).select("key", "value").collect())) == [("a", "2"), ("d", "5")] and small.count() == 2


def test_remaining(spark):
    state = spark.createDataFrame([("a", None), ("b", 60.0)], "key string, expires_at double")
    assert {r.key: r.ttl for r in changelog.remaining(state, F.lit(50.0)).collect()} == {"a": -1.0, "b": 10.0}


def numbered(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines)), "line int, value string")


def test_change_log_lines(spark):
    good = '{"op":"SET","key":"a","value":"1","ts":1.5}'
    assert change_log(numbered(spark, good, "", good)).count() == 2
    assert change_log(numbered(spark, good, '{"op":"SE')).count() == 1
    with pytest.raises(Exception, match="damaged"):
        change_log(numbered(spark, good, '{"op":"SE', good)).collect()
    assert change_log(numbered(spark)).count() == 0


def test_snapshot_then_log(spark):
    base, log = snapshot(numbered(spark, "a 1", "b two words", "")), key_value_log(numbered(spark, "PUT a   9", "DEL b", "", "PUT c x y"))
    assert {r.key: r.value for r in changelog.snapshot_and_log(base, log).collect()} == {"a": "9", "c": "x y"}


def test_eviction(spark):
    rows = spark.createDataFrame([(i, i, 10) for i in range(10)], "id long, used long, size long")
    assert sorted(r.id for r in changelog.evicted(rows, "id", "used", "size", F.lit(35)).collect()) == list(range(7))
    assert changelog.evicted(rows, "id", "used", "size", F.lit(100)).count() == 0


def test_transitions_and_gaps(spark):
    rows = spark.createDataFrame([("t", 1, "PLANNED"), ("t", 2, "APPLIED"), ("t", 4, "PLANNED")], "txn string, seq long, status string")
    allowed = spark.createDataFrame([("PLANNED", "APPLIED")], "before string, after string")
    assert [r.seq for r in changelog.transition_errors(rows, allowed).collect()] == [4]
    assert [tuple(r) for r in changelog.sequence_gaps(rows, "txn", "seq").collect()] == [("t", 4, 2)]
