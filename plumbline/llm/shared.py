"""Where the operators of this subpackage keep tables that must outlive an executor."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.staging import fresh_folder as fresh_path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and that nothing reads any more."""
    for found in tables:
        at = found.sparkSession._jvm.org.apache.hadoop.fs.Path(found.written)
        at.getFileSystem(found.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id="doc_id"):
    """The fifth of the labels that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def among(keys: DataFrame, hashed: Column, bits: int = 1 << 23):
    """A test of other rows' hashes: true for all that keys have, and for few others.

    A bitmap of ``bits`` bits, however many keys there are, goes to every task. Where
    it is full the test lets all rows pass, so it may only save work.
    """
    slot = lambda h: F.pmod(h, F.lit(bits)) + 1
    rows = keys.select(slot(hashed).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")).collect()  # bits / 32,768 rows
    known = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        known[(r["bucket"] - 1) * 4096 :][:4096] = np.frombuffer(r["bitmap"], dtype=np.uint8)

    @F.arrow_udf(T.BooleanType())
    def test(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False) - 1
        return pa.array((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda h: test(slot(h))
