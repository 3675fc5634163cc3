"""Findings of texts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.rules import text


def arriving_units(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Units from Parquet files (file, type, source) that are added to a folder."""
    return spark.readStream.schema("file string, type string, source string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scan_stream(units: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the findings of each batch once; stops when what is there is read."""
    return text.personal_data(units).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def first_seen(findings: DataFrame, key: str = "fingerprint", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream of findings without those whose key came before, within the watermark: the state holds no older keys."""
    return findings.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def commit_new(out: str, key: str = "fingerprint"):
    """A batch writer that adds each key once, and nothing when a batch is replayed.

    A batch replaces the folder of its own id with those of its rows whose key no
    other batch holds; repeated keys of a batch count once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(out)
        new = batch.dropDuplicates([key])
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            held = spark.read.schema(f"{key} string, batch_id bigint").parquet(out).where(F.col("batch_id") != batch_id).select(F.col(key).alias("_held"))
            new = new.join(held, F.col(key) == F.col("_held"), "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def run_once(findings: DataFrame, out: str, checkpoint: str, key: str = "fingerprint") -> StreamingQuery:
    """All that has arrived, committed by batch; stops when what is there is read."""
    return findings.writeStream.foreachBatch(commit_new(out, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
