"""Exact duplicates through an extendible-hash index on shared files.

DataFrame functions only. Four steps:

1. *Keys.* Every row gets the pseudo-key (64-bit hash) and the digest of its
   normalised text; these narrow rows are written.
2. *Directory.* It starts with one slot and doubles until no bucket holds more than
   ``capacity`` pseudo-keys; only overfull buckets split, the others keep their
   local depth and are shared by several slots. Histogram and directory have at most
   2**``max_depth`` rows; a bucket still overfull at that depth overflows.
3. *Buckets.* The directory deals every text to its bucket. Copies in one task are
   collapsed first, so that a text crosses the network once at most and a hot one
   hardly at all. The owner of a bucket compares the bytes of the texts that share
   a pseudo-key: equal ones are one entry with a count and the row that stays, others
   are entries of their own in the chain of that pseudo-key. Owner tasks hold runs of
   buckets and write them as the index file.
4. *Look-up.* Every row goes by its slot in the directory to a bucket of the index
   file, by pseudo-key to a chain and by digest to the entry in it. The row side may
   be skewed to any degree (AQE splits it); the index side has one row per text.

Nulls and edges: a null text counts as empty, and all empty texts are one group;
of equal longest texts the smallest doc_id stays (a null doc_id only if there is
no other); repeated rows count each and carry the same result; an empty table
gives an empty result. Columns besides doc_id and text are ignored, or passed
through ``keep_one`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, materialise, table

BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _slot(key: str, depth: int) -> Column:
    """The first ``depth`` bits of a pseudo-key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(slot at max_depth, bucket, local_depth) of the slots in use; buckets are named by their first slot."""
    distinct = keys.select("pseudo_key").distinct()
    histogram = materialise(distinct.groupBy(_slot("pseudo_key", max_depth).alias("slot")).agg(F.count("*").alias("n")), "dedup-histogram")
    fullest, depth = capacity + 1, -1
    sizes = None
    while fullest > capacity and depth < max_depth:
        depth += 1
        prefix = F.shiftright("slot", max_depth - depth)
        now = histogram.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n")).select(F.lit(depth).alias("depth"), "prefix", "n")
        sizes = now if sizes is None else sizes.unionByName(now)
        fullest = now.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    fits = sizes.where((F.col("n") <= capacity) | (F.col("depth") == depth))
    slots = histogram.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(slot, {max_depth} - depth)"))
    leaf = slots.join(F.broadcast(fits), ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("local_depth"))  # 2**max_depth rows at most
    bucket = F.expr(f"shiftleft(shiftright(slot, {max_depth} - local_depth), {max_depth} - local_depth)")
    return materialise(leaf.select("slot", "local_depth", bucket.alias("bucket")), "dedup-directory")


def _in_bucket(rows: DataFrame, slots: DataFrame, max_depth: int) -> DataFrame:
    """rows with the bucket and local depth that the directory has for their pseudo-key."""
    return rows.withColumn("slot", _slot("pseudo_key", max_depth)).join(F.broadcast(slots), "slot").drop("slot")  # 2**max_depth rows at most


#: Order of the rows of a group as one number: code points, then smaller doc_id, null last.
RANK = f"cast(n_points as decimal(10,0)) * {1 << 65} + coalesce({1 << 63} - cast(doc_id as decimal(20,0)), 0)"


def build_index(documents: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index in bucket order (bucket, local_depth, pseudo_key, chain, digest, keep_id, keep_points, group_size), the keys of all rows (doc_id, n_points, pseudo_key, digest), and the directory."""
    texts = documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), normalised(F.col("text")).alias("normal"))
    texts = texts.select("*", F.xxhash64("normal").alias("pseudo_key"))
    keys = materialise(texts.select("doc_id", "n_points", "pseudo_key", F.sha2("normal", 256).alias("digest")), "dedup-keys")
    slots = directory(keys, capacity, max_depth)
    owned = _in_bucket(texts.select("pseudo_key", "normal", F.expr(RANK).alias("rank")), slots, max_depth)
    # equal bytes within a pseudo-key of a bucket are one entry; collapsed in each task, then once more by the owner
    entries = owned.groupBy("bucket", "local_depth", "pseudo_key", "normal").agg(F.max("rank").alias("best"), F.count("*").alias("group_size"))
    entries = entries.select("bucket", "local_depth", "pseudo_key", F.sha2("normal", 256).alias("digest"), F.expr(f"best div {1 << 65}").alias("keep_points"), F.expr(f"pmod(best, {1 << 65})").alias("rest"), "group_size")
    entries = entries.withColumn("keep_id", F.expr(f"if(rest > 0, {1 << 63} - rest, null)").cast("long")).drop("rest")
    entries = materialise(entries, "dedup-entries")  # else the sampling for the ranges would read the texts again
    chain = F.row_number().over(Window.partitionBy("bucket", "pseudo_key").orderBy("digest"))
    index = materialise(entries.repartitionByRange("bucket", "pseudo_key").withColumn("chain", chain), "dedup-index")
    discard(entries)
    return index, keys, slots


def exact_dedup(documents: DataFrame, capacity: int = 1 << 15, max_depth: int = 16) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index, keys, slots = build_index(documents, capacity, max_depth)
    entry = index.select("bucket", "pseudo_key", "digest", "keep_id", "group_size", "chain")
    found = _in_bucket(keys, slots, max_depth).join(entry.hint("merge"), ["bucket", "pseudo_key", "digest"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "bucket", "chain")


def keep_one(documents: DataFrame, capacity: int = 1 << 15, max_depth: int = 16) -> DataFrame:
    """The rows of documents that stay; of rows that repeat doc_id, normalised text and length one stays."""
    index, keys, slots = build_index(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), capacity, max_depth)
    discard(keys, slots)
    text, none = F.col("text").cast("string"), F.lit(-(1 << 63))
    mine = [F.coalesce(F.col("doc_id").cast("long"), none).alias("id"), F.sha2(normalised(text), 256).alias("digest"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points")]
    stays = index.select(F.coalesce("keep_id", none).alias("id"), "digest", F.col("keep_points").alias("points"))
    # the join deals by the three keys, so that dropping repeated rows needs no further exchange
    rows = documents.select(*mine, F.struct("*").alias("row")).join(stays, ["id", "digest", "points"])
    return rows.dropDuplicates(["id", "digest", "points"]).select("row.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS kept,
       text_sha256
FROM t
"""
