"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) get the weights 3, 1, 2 in
turn and share ``volume`` times all words; a target stops at ``most_copies``
times its source's words, and the excess goes to the others by weight until none
is above (water filling: sources sorted by the level at which they stop).

Copies: with r = target / words of the source, every document is allocated
floor(r) certain whole copies. The rest f = r - floor(r) is drawn as a
Pareto order sample: with U uniform from a hash of the document, documents are
ranked by the random odds U / (1 - U) over the inclusion odds f / (1 - f), and
taken from the smallest on until the source's remaining words are met; the
document at the border is taken if that comes nearer to the target. Inclusion
odds differ from source to source; the size of each source's sample is fixed.

The ranking never sorts a source in one task: ranks fall into ``buckets`` ranges
of equal odds, word counts per range are summed first, and only the range in
which the sample ends is ordered.

Nulls and edges: a null or empty text has size 0 and takes no words; a null
source is a source; repeated rows draw the same U, are ordered among themselves
by size, and each counts; an empty table gives an empty result; a source without
words has target 0. Extra columns pass through ``mix_documents`` untouched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import materialise, table
from .wordhash import count_words

WEIGHTS = (3, 1, 2)


@F.arrow_udf(T.LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Runs of other characters than space and \\t to \\r."""
    return pa.array(count_words(texts))


def targets(sizes: DataFrame, weights=WEIGHTS, volume: float = 1.5, most_copies: int = 2) -> DataFrame:
    """source, source_size, target of each source; a row per source goes through one ordered window."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum(F.lit(most_copies) * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("level", (F.lit(volume) * F.sum("source_size").over(whole) - stopped) / left)
    # the first source that does not stop sets the level; those before it stop
    goes_on = F.col("level") * F.col("weight") <= F.lit(float(most_copies)) * F.col("source_size")
    level = F.min(F.when(goes_on, F.struct(F.col("source_size") / F.col("weight"), "level"))).over(whole)["level"]
    share = F.least(F.lit(float(most_copies)) * F.col("source_size"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return each.select("source", "source_size", share.alias("target"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + 0.5) / float(1 << 52)


def copies(sizes: DataFrame, shares: DataFrame, rows_per_bucket: int = 5000) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target and the number of copies that the mix takes."""
    buckets = max(1024, 1 << max(0, sizes.count() // rows_per_bucket).bit_length())
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = shares.select(F.col("source").alias("_source"), "source_size", "target", F.floor(ratio).alias("certain"))
    shares = shares.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")).withColumn("f", ratio - F.col("certain"))
    shares = materialise(shares, "mixing-targets")
    drawn = sizes.join(shares, F.col("source").eqNullSafe(F.col("_source"))).withColumn("u", uniform(F.col("doc_id")))
    # within a source f is one number, so that equal steps of U are equal steps of the ranked odds
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))
    drawn = drawn.withColumn("rank", F.when((F.col("f") > 0) & (F.col("f") < 1), rank)).withColumn("bucket", F.floor(F.col("u") * buckets))
    sums = drawn.where("rank is not null").groupBy("_source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = materialise(
        sums.withColumn("before", before).where("before <= rest and before + n > rest").groupBy("_source").agg(F.min(F.struct("bucket", "before")).alias("b"))
        .select(F.col("_source").alias("s"), F.col("b.bucket").alias("border"), F.col("b.before").alias("before")), "mixing-borders")
    drawn = drawn.join(border, F.col("_source").eqNullSafe(F.col("s")), "left")
    inside = F.col("rank").isNotNull() & ((F.col("bucket") < F.col("border")) | F.col("border").isNull())
    at_border = F.col("rank").isNotNull() & (F.col("bucket") == F.col("border"))
    keep = ["doc_id", "source", "size", "source_size", "target", "certain"]
    running = F.coalesce(F.sum("size").over(Window.partitionBy("_source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = drawn.where(at_border).select(*keep, "_source", "rank", (F.col("rest") - F.col("before")).alias("room")).withColumn("running", running)
    nearer = F.col("running") + F.col("size") / 2.0 <= F.col("room")
    return drawn.where(~F.coalesce(at_border, F.lit(False))).select(*keep, F.coalesce(inside, F.lit(False)).cast("long").alias("drawn")).unionByName(ordered.select(*keep, nearer.cast("long").alias("drawn"))).withColumn("copies", F.col("certain") + F.col("drawn"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, copies."""
    sizes = materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")), "mixing-sizes")
    return copies(sizes, targets(sizes, **options))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of documents, each as often as the mix takes it.

    Rows of equal doc_id, source and size share their draw; if the sample ends among
    them, the copies that are left go to the first by a hash of the text.
    """
    id_, source = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("of")
    text = F.col("text").cast("string")
    taken = mix(documents, **options).select(id_, source, "size", "copies").groupBy("id", "of", "size").agg(F.sum("copies").alias("total"), F.count("*").alias("rows"))
    rows = documents.select(id_, source, word_count(text).alias("size"), F.xxhash64(text).alias("order"), F.struct("*").alias("document"))
    # the window deals by the keys of the join, so that it needs no further exchange
    found = rows.join(taken, ["id", "of", "size"]).withColumn("turn", F.row_number().over(Window.partitionBy("id", "of", "size").orderBy("order")))
    copies = F.expr("total div rows + if(turn <= total % rows, 1, 0)")
    return found.withColumn("copies", copies).where("copies > 0").select("document", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("document.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (
  SELECT *, source_size / weight AS stops_at,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
m AS (SELECT arg_min(level, stops_at) FILTER (level * weight <= 2.0::DOUBLE * source_size) AS level FROM l),
r AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(m.level, 'inf'::DOUBLE) * weight) AS target FROM l, m),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM r),
d AS (
  SELECT t.doc_id, t.size, t.u, q.*, target - certain * source_size AS rest,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END - certain AS f
  FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source),
o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d)
SELECT doc_id, size, source_size, target,
       (certain + CASE WHEN f > 0 AND f < 1 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM o
"""
