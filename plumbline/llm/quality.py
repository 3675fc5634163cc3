"""Quality selection by importance resampling.

Two bags of hashed n-grams (words and runs of punctuation; one and two tokens)
are counted: one over the texts labelled good, one over all raw texts. A text's
log importance is the sum, over its n-grams, of the log ratio of the two models;
the target is smoothed with the raw model. A sample without replacement is drawn
by Gumbel top-k: log importance plus Gumbel noise from a hash of doc_id, of which
the k greatest stay, so that of two texts the one with e times the importance is
drawn e times as readily. ``size`` is k, or a share of the rows if it is below 1;
without it, k is the number of texts whose log importance passes the cut that best
tells the labels of a fold apart that the target model has not seen. As log
importance is a sum over a whole text, noise decides among texts near the k-th only.

Parameters: ``slots`` per n-gram order (the models are vectors of that size);
``label_rows`` bounds the labelled rows that are used, chosen by hash of doc_id.
Raw counts, scores and selection cover all rows and whole texts; the k-th
greatest key is found by refining a histogram, never by a global sort.

Nulls and edges: a null or empty text has log importance 0; a null label is no
label; a doc_id labelled twice takes the smaller label; repeated rows are scored
each and draw the same noise, and all rows that tie with the k-th key stay; with
no good label in the fit every row stays. Extra columns pass through ``select``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise, table
from .wordhash import BLANKS, PUNCTUATION, hash_prefixes, pair_key, text_chunks

UNIT = 1 << 20  # log ratios are whole multiples of 1 / UNIT, so that their sums are exact


def _ngrams(raw: np.ndarray, bounds: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all tokens, slots of the pairs that begin at each token (or -1), row bounds in tokens."""
    (words,), rows = hash_prefixes(raw, bounds, (None,), BLANKS, PUNCTUATION)
    pairs = np.full(len(words), -1, np.int64)
    if len(words) > 1:
        key = pair_key(words[:-1], words[1:])
        key[words[:-1] == words[1:]] = 0  # a repeated token is the same event whatever the token
        pairs[:-1] = slots + (key % np.uint64(slots)).astype(np.int64)
        ends = rows[1:] - 1
        pairs[ends[(ends >= 0) & (np.diff(rows) > 0)]] = -1
    return (words % np.uint64(slots)).astype(np.int64), pairs, rows


def _counter(slots: int):
    def run(batches):
        counts = np.zeros((2, 2 * slots), np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False)
            for row, raw, bounds in text_chunks(batch.column("text")):
                words, pairs, rows = _ngrams(raw, bounds, slots)
                chosen = np.repeat(good[row : row + len(rows) - 1], np.diff(rows))
                for ngrams in (words, pairs):
                    counts[0] += np.bincount(ngrams[ngrams >= 0], minlength=2 * slots)
                    counts[1] += np.bincount(ngrams[(ngrams >= 0) & chosen], minlength=2 * slots)
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["slot", "n_raw", "n_good"])

    return run


def log_ratios(counts, slots: int, smoothing: float = 10.0) -> np.ndarray:
    """Log ratio of target to raw of each slot, in whole units."""
    out = np.zeros(2 * slots, np.int64)
    raw, good = np.zeros(2 * slots), np.zeros(2 * slots)
    raw[counts["slot"]], good[counts["slot"]] = counts["n_raw"], counts["n_good"]
    for order in (slice(0, slots), slice(slots, None)):
        r, g = raw[order], good[order]
        if r.sum() and g.sum():
            share = r / r.sum()
            target = (g + smoothing * slots * share) / (g.sum() + smoothing * slots)
            out[order] = np.round(UNIT * np.log(np.divide(target, share, out=np.ones_like(r), where=r > 0)))
    return out


def log_importance(text: Column, ratios: np.ndarray) -> Column:
    slots = len(ratios) // 2

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for row, raw, bounds in text_chunks(texts):
            words, pairs, rows = _ngrams(raw, bounds, slots)
            total = np.concatenate([[0], np.cumsum(ratios[words] + np.where(pairs >= 0, ratios[pairs], 0))])
            out[row : row + len(rows) - 1] = (total[rows[1:]] - total[rows[:-1]]) / UNIT
        return pa.array(out)

    return run(text)


def gumbel(doc_id: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("quality"), doc_id), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_greatest(keys: DataFrame, column: str, k: int, at_once: int = 10_000, bins: int = 1024) -> float:
    """The k-th greatest value: histograms of ever smaller ranges, then at most ``at_once`` values (more only if they are equal)."""
    if k <= 0:
        return math.inf
    keys = keys.select(F.col(column).alias("x"))
    low, high = keys.agg(F.min("x"), F.max("x")).first()
    while True:
        inside = keys.where((F.col("x") >= low) & (F.col("x") <= high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return low
        bin_ = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("bin")
        found = inside.groupBy(bin_).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy(F.desc("bin")).collect()  # bins rows at most
        for row in found:
            if k <= row["n"]:
                break
            k -= row["n"]
        else:
            return low
        low, high = row["low"], row["high"]
        if row["n"] <= at_once:
            values = keys.where((F.col("x") >= low) & (F.col("x") <= high)).orderBy(F.desc("x")).limit(at_once).collect()
            return values[k - 1]["x"]


def fit(documents: DataFrame, labels: DataFrame, slots: int = 1 << 14, label_rows: int = 200_000) -> tuple[np.ndarray, DataFrame]:
    """The log ratios, and the labels of the fold kept for the cut: doc_id, quality."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = known.where(fold != 0)
    share = min(1.0, label_rows / max(1, known.count()))
    known = materialise(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "quality-labels")
    good = known.where((fold != 4) & (F.col("quality") > 0)).select(F.col("doc_id").alias("_good"))
    marked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(good), F.col("doc_id") == F.col("_good"), "left")  # label_rows ids at most
    counts = marked.select("text", F.col("_good").isNotNull().alias("good")).mapInArrow(_counter(slots), "slot long, n_raw long, n_good long")
    counts = counts.groupBy("slot").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_good").alias("n_good")).toPandas()  # 2 * slots rows at most
    return log_ratios(counts, slots), known.where(fold == 4)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float | None:
    """The middle of the widest gap among the cuts with the best mean of both classes' accuracies."""
    if not len(scores) or good.all() or not good.any():
        return None
    edges = np.unique(scores)
    edges = np.concatenate([[edges[0] - 2], edges, [edges[-1] + 2]])
    cuts, gaps = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    right = np.searchsorted(np.sort(scores[~good]), cuts) / (~good).sum() - np.searchsorted(np.sort(scores[good]), cuts) / good.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[gaps[best].argmax()]])


def score(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_importance, gumbel_key and the whole row (document)."""
    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), log_importance(F.col("text").cast("string"), ratios).alias("log_importance"), F.struct("*").alias("document"))
    return scored.withColumn("gumbel_key", F.col("log_importance") + gumbel(F.col("doc_id")))


def resample(documents: DataFrame, labels: DataFrame, size: float | None = None) -> tuple[np.ndarray, DataFrame, float]:
    """The log ratios, the scores of all rows (doc_id, log_importance, gumbel_key), and the k-th greatest key."""
    ratios, checked = fit(documents, labels)
    scores = materialise(score(documents, ratios).drop("document"), "quality-scores")
    if size is not None:
        k = round(size * scores.count()) if size < 1 else int(size)
    else:
        seen = scores.join(F.broadcast(checked.withColumnRenamed("doc_id", "id")), F.col("doc_id") == F.col("id"))  # label_rows ids at most
        seen = seen.groupBy("id", "quality").agg(F.min("log_importance").alias("x")).toPandas()
        cut = best_cut(seen["x"].to_numpy(dtype=float), seen["quality"].to_numpy() > 0)
        k = scores.count() if cut is None else scores.where(F.col("log_importance") >= cut).count()
    return ratios, scores, kth_greatest(scores, "gumbel_key", k)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    _, scores, least = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("kept", F.col("gumbel_key") >= least)


def select(documents: DataFrame, labels: DataFrame, size: float | None = None) -> DataFrame:
    """The rows of documents that the sample keeps."""
    ratios, _, least = resample(documents, labels, size)
    return score(documents, ratios).where(F.col("gumbel_key") >= least).select("document.*")
