"""Tables that several branches of a plan read: written once to the cluster's shared folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where that is unset and Spark runs on this one machine, a temporary folder is
    made and set; elsewhere a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows_per_task: int = 2000) -> DataFrame:
    """df dealt to tasks of about so many rows.

    For small rows of which each becomes a long text: a file of a few megabytes
    holds a million of them, and would be one task.
    """
    return df.repartition(max(1, math.ceil(df.count() / rows_per_task)))


def by_file(units: DataFrame, bytes_per_task: int = 4_000_000) -> tuple[DataFrame, int]:
    """units dealt by file to tasks of about so much text, and their number: what is grouped or ordered by file after this is not dealt again."""
    parts = max(1, math.ceil((units.agg(F.sum(F.octet_length("source").cast("long"))).first()[0] or 0) / bytes_per_task))
    return units.repartition(parts, "file"), parts


def clustered(df: DataFrame, label: str, parts: int) -> DataFrame:
    """As staged, in so many buckets of files: what reads it by file needs no shuffle."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(parts, "file").option("path", path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its name goes: the data lie at a path of their own
    return found
