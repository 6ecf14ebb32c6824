"""The cluster's shared folder, for tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session of one machine (master local) without the setting writes, as in tests.
UNSET_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder (spark.checkpoint.dir). Where it is unset a local session gets a folder of its machine; a cluster must set it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = UNSET_DIR
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found and not found.startswith("file:"):
        found = f"file://{found}"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, and any executor can read it again."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that written() gave, once nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
