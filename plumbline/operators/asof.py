"""The last value before a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_before(uses: DataFrame, values: DataFrame, keys: tuple[str, ...], place: str, columns: tuple[str, ...]) -> DataFrame:
    """uses with ``columns`` of the last of values whose place is smaller and whose keys are equal; nulls where there is none.

    Uses and values are one ordered stream by key, over which the last value runs on:
    no pair of a use and an earlier value is made. Null keys equal each other. Of values
    at one place the greatest counts; a value at the place of a use comes too late.
    """
    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    both = uses.withColumns({"_use": F.lit(True), "_value": F.lit(None).cast(values.select(packed.alias("v")).schema["v"].dataType)})
    given = values.select(*keys, place, F.lit(False).alias("_use"), packed.alias("_value"))
    w = Window.partitionBy(*keys).orderBy(place, F.col("_use").desc(), "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = both.unionByName(given, allowMissingColumns=True).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_use")
    return joined.select(*[F.col(c) for c in uses.columns if c not in columns], *[F.col(f"_last.{c}").alias(c) for c in columns])
