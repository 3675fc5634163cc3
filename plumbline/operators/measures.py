"""Mutation summaries and score history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KILLED, SURVIVED, NOT_COVERED = ("killed", "killed by SA"), ("escaped", "timed out"), ("not covered",)


def _rate(killed, denominator):
    return F.round(F.when(denominator > 0, 100 * killed / denominator).otherwise(0.0), 2)


def mutation_summary(mutants: DataFrame, by: str | None = "file") -> DataFrame:
    """total, killed, survived, not_covered, msi and covered_msi, by file or in all."""
    n = lambda names: F.count_if(F.col("status").isin(*names))
    counts = (mutants.groupBy(by) if by else mutants.groupBy()).agg(F.count("*").alias("total"), n(KILLED).alias("killed"), n(SURVIVED).alias("survived"), n(NOT_COVERED).alias("not_covered"))
    killed, seen = F.col("killed"), F.col("killed") + F.col("survived")
    return counts.withColumn("msi", _rate(killed, seen + F.col("not_covered"))).withColumn("covered_msi", _rate(killed, seen))


def mutation_findings(mutants: DataFrame, survivor_budget: int | None = None, base_msi: float | None = None) -> DataFrame:
    """A finding per surviving mutant, one if there are too many, one if the score fell: kind, file, line, message."""
    rows = mutants.where(F.col("status").isin(*SURVIVED)).select(F.lit("survivor").alias("kind"), "file", "line", F.concat(F.lit("Mutant "), "mutator", F.lit(" "), "status").alias("message"))
    total = mutation_summary(mutants, by=None)
    none = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line")]
    if survivor_budget is not None:
        rows = rows.unionByName(total.where(F.col("survived") > survivor_budget).select(F.lit("budget").alias("kind"), *none, F.format_string("%d mutants survive, %d may", F.col("survived"), F.lit(survivor_budget)).alias("message")))
    if base_msi is not None:
        rows = rows.unionByName(total.where(F.round(F.col("msi") - base_msi, 2) < 0).select(F.lit("regression").alias("kind"), *none, F.lit("The mutation score fell").alias("message")))
    return rows


def with_previous(history: DataFrame) -> DataFrame:
    """history with the previous score of the same scope and the change; no scope is the full project."""
    scope = F.coalesce("scope", F.lit("full-project"))
    previous = F.lag("score").over(Window.partitionBy("scope").orderBy("ord"))
    return history.withColumn("scope", scope).withColumn("previous", previous).withColumn("delta", F.round(F.col("score") - F.col("previous"), 2))


def trimmed(history: DataFrame, keep: int = 50) -> DataFrame:
    """The newest entries of each scope."""
    rows = history.withColumn("scope", F.coalesce("scope", F.lit("full-project")))
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("ord")))).where(F.col("_place") <= keep).drop("_place")


def append_history(history: DataFrame, entry: DataFrame, keep: int = 50) -> DataFrame:
    return trimmed(history.unionByName(entry, allowMissingColumns=True), keep)
