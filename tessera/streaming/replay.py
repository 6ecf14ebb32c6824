"""Streaming forms: running counts, and the newest value of each key, from files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import fresh_dir


def file_stream(spark: SparkSession, path: str, like: DataFrame, pattern: str = "*") -> DataFrame:
    """A stream of the Parquet files below a folder whose names fit the pattern."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(path)


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream gives of all that is there now. Its progress and its result are in the shared folder."""
    spark = stream.sparkSession
    top = fresh_dir(spark, f"stream-{name}")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure replaces what it wrote
        place = "all" if mode == "complete" else f"{number:020}"
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{top}/out/{place}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    written = stream.sparkSession.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0).cast("long")).schema
    return spark.read.schema(written).option("recursiveFileLookup", True).parquet(f"{top}/out").drop(*([] if mode == "update" else ["_batch"]))


def counts(events: DataFrame, by: str) -> DataFrame:
    return events.groupBy(by).agg(F.count("*").alias("n"))


def latest_values(changes: DataFrame) -> DataFrame:
    """A stream of changes (seq, op, key, value) as a stream of each key's state: key, value, seq (value null once deleted). One running aggregate a key, in update mode. FLUSH can't be kept by key and is refused."""
    checked = changes.withColumn("op", F.when(F.col("op") == "FLUSH", F.raise_error(F.lit("FLUSH is for batches"))).otherwise(F.col("op")))
    last = checked.groupBy("key").agg(F.max_by(F.struct(F.when(F.col("op") != "DELETE", F.col("value")).alias("value"), "seq"), "seq").alias("_x"))
    return last.select("key", "_x.value", "_x.seq")


def newest_updates(updates: DataFrame, key: str) -> DataFrame:
    """What drained() gives in update mode, of each key the row of its last batch."""
    rest = [c for c in updates.columns if c not in (key, "_batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_x")).select(key, "_x.*")


def indexed(events: DataFrame, session: str, order: str, size: str) -> DataFrame:
    """events with index (from 0) and offset (sizes before) in each session, as an append stream numbers them."""
    from pyspark.sql import Window

    by = Window.partitionBy(session).orderBy(order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumns({"index": (F.row_number().over(by) - 1).cast("long"), "offset": F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long")})
