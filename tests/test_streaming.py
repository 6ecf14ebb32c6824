from tessera.streaming import replay


def test_counts_and_latest(spark, tmp_path):
    rows = [(1, "SET", "a", "1"), (2, "SET", "b", "2"), (3, "DELETE", "a", None), (4, "SET", "b", "5")]
    frame = spark.createDataFrame(rows, "seq long, op string, key string, value string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = replay.file_stream(spark, str(tmp_path / "in"), frame, "*.parquet")
    assert {r.op: r.n for r in replay.drained(replay.counts(stream, "op"), "complete", "c").collect()} == {"SET": 3, "DELETE": 1}
    assert {r.key: (r.value, r.seq) for r in replay.drained(replay.latest_values(stream), "update", "l").collect()} == {"a": (None, 3), "b": ("5", 4)}
