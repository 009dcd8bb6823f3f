"""Incremental runs: pages and pairs as they come in, each once, with counts by window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(pairs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no result yet."""
    return pairs.join(done.select(*keys).distinct(), keys, "left_anti")


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 50) -> DataFrame:
    """New files of a folder as a stream, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark has passed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and their distinct users by window and kind."""
    g = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
    return g.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), kind, "n", "users")


def append_results(events: DataFrame, work, out: str, checkpoint: str, keys: list[str]):
    """Runs `work` over each batch's unseen rows and appends what it returns; a batch that is repeated after a failure adds nothing."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(out)
        rows = batch.dropDuplicates(keys)
        if at.getFileSystem(conf).exists(at):
            rows = pending(rows, spark.read.parquet(out), keys)
        work(rows).write.mode("append").parquet(out)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
