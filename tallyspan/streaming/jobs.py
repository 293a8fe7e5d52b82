"""Structured Streaming forms of the event operators; each runs over what is there and ends (availableNow)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder of the cluster; a temporary one only where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    return f"{base}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, name: str, at: str) -> DataFrame:
    """A stream over the files of a table; the time column becomes a timestamp with zone, as watermarks need it."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    source = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if path.endswith(".parquet") else reader.parquet(path)
    return source.withColumn(at, F.col(at).cast("timestamp"))


def run_to_files(stream: DataFrame) -> DataFrame:
    """Run an append stream to its end and read what it wrote."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update stream to its end and read the last version of every key, windows that are still open included."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_number={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    made = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch_number", T.LongType())])).parquet(f"{folder}/out")
    values = [c for c in stream.columns if c not in keys]
    return made.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_number").alias("last")).select(*keys, "last.*")


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Idempotent append: later deliveries of an id within the watermark are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, delay: str, group: str, value: str) -> DataFrame:
    """Count and sum of every window: closed ones in append mode, all as they change in update mode."""
    return (
        stream.withWatermark(at, delay)
        .groupBy(F.window(at, width).alias("w"), group)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), group, "n", "total")
    )
