"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary text.

An expression is a word, read as three nested units: its first four bytes, its
first six, the whole word. Each class has an interpolated Kneser-Ney model of a
unit given the shorter unit of the same word: counts are continuation counts
(distinct words to the left, so that copied lines count once; the word to the left
has no other part in the model), a discount is taken from each, and the mass so
freed goes to a backoff distribution that both classes share. A unit
too rare to pass the discount therefore has nearly the same probability in both
classes. The score compares the two log-likelihoods, divided by the length in
words; differences of single words below ``min_evidence`` nats are taken as
noise of the estimate.

Parameters that bound the fit: ``rows_per_class`` labelled rows of each class
(least hash of doc_id first) and ``calibration_rows`` more for the threshold. All
units of those rows count in the totals, in the freed mass and in the shared
distribution, which are taken before any unit is left out. A unit that passes the
discount in neither class has the log ratio of its parent's backoff weights, which
a lookup falls back to; so the model need not list it, and nothing is lost.
Scoring reads every row and whole text.

Nulls and edges: a null or empty text has no evidence and a score below 0.5; a
null label is no label; a doc_id labelled twice takes the larger label; repeated
documents are scored each; with no label of one class every score is 0.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import is_held_out, materialise, table
from .wordhash import BLANKS, PUNCTUATION, hash_prefixes, pair_key, text_chunks

LENGTHS = (4, 6, None)
UNIT = 1 << 20  # log ratios are summed in whole multiples of 1 / UNIT: sums are exact in any order
SEPARATORS = BLANKS + PUNCTUATION
UNIT_SCHEMA = "toxic boolean, level int, unit long, parent long, before long"


@dataclass
class Model:
    """For each level: sorted units with their log ratio, sorted parents with the log ratio of their backoff weights."""

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    min_evidence: float
    threshold: float = 0.0
    slope: float = 0.0

    def word_ratios(self, units: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(units[0]))
        for level, (keys, ratio, parents, backoff) in enumerate(self.levels):
            rest = _lookup(parents, backoff, units[level - 1] if level else np.zeros(len(total), np.uint64), 0.0)
            total += _lookup(keys, ratio, units[level], rest)
        return np.where(np.abs(total) >= self.min_evidence, np.round(total * UNIT), 0.0).astype(np.int64)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """The length-normalised difference of the two log-likelihoods of each text."""
        out = np.zeros(len(texts))
        for row, raw, bounds in text_chunks(texts):
            units, rows = hash_prefixes(raw, bounds, LENGTHS, SEPARATORS)
            run = np.concatenate([[0], np.cumsum(self.word_ratios(units))])
            out[row : row + len(rows) - 1] = (run[rows[1:]] - run[rows[:-1]]) / UNIT / np.maximum(1, np.diff(rows))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.threshold), -30, 30))) if self.slope else np.zeros(len(evidence))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(missing, wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (unit, parent, word before) of each text."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for row, raw, bounds in text_chunks(batch.column("text")):
            units, rows = hash_prefixes(raw, bounds, LENGTHS, SEPARATORS)
            before = np.roll(units[2], 1)
            before[rows[:-1][rows[:-1] < len(before)]] = 0
            owner = np.repeat(toxic[row : row + len(rows) - 1], np.diff(rows))
            for level in range(len(LENGTHS)):
                parent = units[level - 1] if level else np.zeros_like(before)
                _, keep = np.unique(pair_key(before, units[level]) + owner.astype(np.uint64), return_index=True)
                columns = [owner[keep], np.full(len(keep), level, np.int32), *(x[keep].view(np.int64) for x in (units[level], parent, before))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["toxic", "level", "unit", "parent", "before"])


def _log_ratios(level, groups, discount: float, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the units that pass the i-th discount in a class; groups: totals and freed mass of their parents, over all units."""
    groups = groups.sort_values("parent_key")
    parents = groups["parent_key"].to_numpy()
    level = level[np.maximum(level["n_toxic"], level["n_ordinary"]) > discount]
    group = np.searchsorted(parents, level["parent"].to_numpy().view(np.uint64))
    counts = [level[c].to_numpy(dtype=float) for c in ("n_toxic", "n_ordinary")]
    totals = [groups[c].to_numpy(dtype=float) for c in ("toxic", "ordinary")]
    shared = 0.98 * (counts[0] + counts[1]) / (totals[0] + totals[1])[group]  # the rest is for units not seen
    unit, weight = [], []
    for n, total, side in zip(counts, totals, ("toxic", "ordinary"), strict=True):
        known = total > 0
        share = np.divide(groups[f"freed_{side}_{i}"].to_numpy(dtype=float), total, out=np.ones_like(total), where=known)
        seen = np.divide(np.maximum(n - discount, 0), total[group], out=np.zeros_like(n), where=known[group])
        unit.append(np.log(seen + share[group] * shared))
        weight.append(np.log(share))
    keys = level["unit"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (unit[0] - unit[1])[order], parents, weight[0] - weight[1]


def fit(documents: DataFrame, labels: DataFrame, rows_per_class: int = 2500, calibration_rows: int = 4000, discounts=(5.0, 2.0, 1.0), evidences=(3.0, 2.0, 1.0)) -> Model:
    """Learn from labels that are not held out; a fifth of all labels sets the threshold and picks discount and evidence."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(~is_held_out())
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    order = [F.xxhash64("doc_id"), "doc_id"]
    train = [known.where((fold != 4) & (F.col("toxic") == toxic)).orderBy(*order).limit(rows_per_class) for toxic in (True, False)]
    chosen = train[0].unionByName(train[1]).withColumn("fits", F.lit(True)).unionByName(known.where(fold == 4).orderBy(*order).limit(calibration_rows).withColumn("fits", F.lit(False)))
    # at most 2 * rows_per_class + calibration_rows ids
    sample = materialise(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-sample")
    counted = materialise(
        sample.where("fits").select("toxic", "text").mapInArrow(_units, UNIT_SCHEMA).distinct()
        .groupBy("level", "unit", "parent").agg(F.count_if("toxic").alias("n_toxic"), F.count_if(~F.col("toxic")).alias("n_ordinary")),
        "toxicity-units",
    )
    # the rest has the log ratio of its parent's backoff weights (1 : 1 where no child of the parent passes)
    passing = F.greatest("n_toxic", "n_ordinary") > min(discounts)
    units = counted.where(passing).toPandas()
    freed = [F.sum(F.least(F.col(f"n_{side}").cast("double"), F.lit(float(d)))).alias(f"freed_{side}_{i}") for i, d in enumerate(discounts) for side in ("toxic", "ordinary")]
    groups = counted.groupBy("level", "parent").agg(F.sum("n_toxic").alias("toxic"), F.sum("n_ordinary").alias("ordinary"), F.max(passing).alias("passing"), *freed).where("passing").drop("passing").toPandas()
    groups["parent_key"] = groups["parent"].to_numpy().view(np.uint64)
    best, checked = Model([], 0.0), sample.where("not fits").select("toxic", "text")
    met = counted.agg(F.max("n_toxic"), F.max("n_ordinary")).first()
    if not (met[0] and met[1]):
        return best
    models = []
    for i, d in enumerate(discounts):
        levels = [_log_ratios(units[units["level"] == level], groups[groups["level"] == level], d, i) for level in range(len(LENGTHS))]
        models += [Model(levels, e) for e in evidences]

    def judged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x.tolist() for x in np.stack([m.evidence(batch.column("text")) for m in models], axis=1)], pa.list_(pa.float64()))], ["toxic", "evidence"])

    rows = checked.mapInArrow(judged, "toxic boolean, evidence array<double>").toPandas()
    toxic = rows["toxic"].to_numpy(dtype=bool)
    if not len(rows) or toxic.all() or not toxic.any():
        best = models[0]
        best.threshold, best.slope = 0.01, 400.0
        return best
    most = -1.0
    for model, x in zip(models, np.stack(rows["evidence"].to_list(), axis=1), strict=True):
        cut = np.unique(x)
        cut = np.concatenate([[cut[0] - 1], (cut[1:] + cut[:-1]) / 2, [cut[-1] + 1]])
        caught = [1 - np.searchsorted(np.sort(x[toxic == side]), cut) / (toxic == side).sum() for side in (True, False)]
        right = caught[0] - caught[1]  # balanced: toxic rows are few
        if right.max() > most + 1e-9:
            most, best = right.max(), model
            best.threshold = float(cut[right.argmax()])
    best.slope = 4 / max(abs(best.threshold), 1e-3)
    return best


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence of every row."""

    def scored(batches):
        for batch in batches:
            x = model.evidence(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x)), pa.array(x)], ["doc_id", "score", "evidence"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double, evidence double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
