"""Centroid clustering of integer vectors, with Ptolemaic lower bounds from fixed pivots.

Lloyd's rounds in exact integers: every vector goes to its nearest centroid, every
centroid becomes the componentwise floor of the mean of its vectors. For any four
points Ptolemy's inequality bounds the distance of vector x and centroid c from below:

    d(x, c) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)| / d(p, q)

for fixed pairs of pivots p, q. A bound is close to the distance where p is close to the
centroid and q far from it. The first pivots are the first centroids; three rounds
later the centroids of that round join them, each paired with two of the first. From
then on they stay fixed. A vector's distances to the pivots are computed once and written
beside it; in each round only the few centroids meet the pivots anew. A vector first
meets the centroid with the smallest bound exactly, and then those others whose bound
does not exceed what it has found. Bounds are lowered by more than their rounding errors,
so that no centroid that could be nearest, or as near with a smaller number, is left out.
How many distances that saves depends on how far centroids still move and how well
clusters are apart: where all vectors are about equally far from all centroids, few.

A round is one narrow scan: each task returns one row a cluster and component, which
Spark adds up; the driver sees clusters times components sums.

Nulls and edges: vectors that are null, of another length, or hold a null or non-finite
component are left out. A null id hashes like an empty one; equal ids are ordered by
their vectors. With fewer vectors than clusters there are as many centroids as vectors;
without any there are no rows. Pivots that coincide bound nothing. Components beyond
2^27 are compared and added up as integers of any size, to 10^66; a distance or inertia
that exceeds a long is null. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, table

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: The number of rounds after which their centroids become pivots.
SETTLED = 3
#: More than the rounding errors of a bound, in units of what is subtracted.
SLACK = 16 * np.finfo(float).eps
EXACT = 1 << 27
#: Sums go to Spark as two decimals, multiples of this and the rest.
PART = 10**30


def integers(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and x: floor(scale * component) as doubles, of vectors that are whole and finite."""
    x = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf")))
    floored = rows.where(F.size("x") == dimensions).where(finite).withColumn("x", F.transform("x", lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0)))
    return floored


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of seed:id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    return [[int(v) for v in r["x"]] for r in rows]


def _matrix(column) -> np.ndarray:
    """The vectors of a batch as exact integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if not len(flat) or np.abs(flat).max() < EXACT:
        return flat.astype(np.int64)
    return np.array([[int(v) for v in row] for row in flat], dtype=object)


def _squared(rows: np.ndarray, point: list[int]) -> np.ndarray:
    exact = rows.dtype != object and max(map(abs, point), default=0) < EXACT
    difference = (rows if exact else rows.astype(object)) - np.array(point, dtype=np.int64 if exact else object)
    return (difference * difference).sum(axis=1)


def _norms(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def _with_pivots(pivots: list[list[int]]):
    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column("x"))
            near = np.stack([_norms(_squared(rows, p)) for p in pivots], axis=1) if len(rows) else np.zeros((0, len(pivots)))
            ends = pa.array(np.arange(0, near.size + 1, len(pivots)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))], ["vec_id", "x", "near"])

    return run


class Bounds:
    """Lower bounds of the squared distances to the centroids of one round."""

    def __init__(self, pivots: list[list[int]], pairs: list[tuple[int, int]], centroids: list[list[int]]):
        spread = _matrix_of(pivots)
        self.pairs = [(i, j, float(np.sqrt(float(_squared(spread[i : i + 1], pivots[j])[0])))) for i, j in pairs]
        self.pairs = [(i, j, d) for i, j, d in self.pairs if d > 0]
        self.of_centroids = np.stack([_norms(_squared(spread, c)) for c in centroids])  # centroid, pivot

    def squares(self, near: np.ndarray) -> np.ndarray:
        """near: a vector's distances to the pivots, a row each; returns vector, centroid."""
        bound = np.zeros((len(near), len(self.of_centroids)))
        for i, j, apart in self.pairs:
            one, two = near[:, i : i + 1] * self.of_centroids[:, j], near[:, j : j + 1] * self.of_centroids[:, i]
            np.maximum(bound, (np.abs(one - two) - SLACK * (one + two)) / apart, out=bound)
        return bound * bound * (1 - SLACK)


def _matrix_of(points: list[list[int]]) -> np.ndarray:
    return np.array(points, dtype=np.int64 if max((abs(v) for p in points for v in p), default=0) < EXACT else object)


def nearest(rows: np.ndarray, near: np.ndarray, centroids: list[list[int]], bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the first of equal ones), its squared distance, and how many distances were computed."""
    bound = bounds.squares(near)
    first = bound.argmin(axis=1)
    kind = object if rows.dtype == object or _matrix_of(centroids).dtype == object else np.int64
    best, at, computed = np.empty(len(rows), dtype=kind), first.copy(), len(rows)
    for c in np.unique(first):
        own = first == c
        best[own] = _squared(rows[own], centroids[c])
    for c in range(len(centroids)):
        left = np.flatnonzero((first != c) & (bound[:, c] <= best.astype(float) * (1 + SLACK)))
        if len(left):
            found = _squared(rows[left], centroids[c])
            closer = (found < best[left]) | ((found == best[left]) & (c < at[left]))
            best[left[closer]], at[left[closer]] = found[closer], c
            computed += len(left)
    return at, best, computed


def _batch(batch, width: int):
    return _matrix(batch.column("x")), batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(pivots, pairs, centroids):
    """Per task: count (component -2), computed distances (-1, of all clusters in the first row) and component sums of each cluster."""
    def run(batches):
        bounds, dimensions = Bounds(pivots, pairs, centroids), len(pivots[0])
        total = np.zeros((len(centroids), dimensions + 2), dtype=object)
        for batch in batches:
            rows, near = _batch(batch, len(pivots))
            at, _, computed = nearest(rows, near, centroids, bounds)
            total[0, 1] += computed
            for c in np.unique(at):
                own = rows[at == c]
                total[c, 0] += len(own)
                total[c, 2:] += own.sum(axis=0).astype(object)
        cells = [(c, i - 2, *map(Decimal, divmod(int(v), PART))) for c, row in enumerate(total) for i, v in enumerate(row)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*cells, strict=True), kinds, strict=True)], ["cluster", "component", "high", "low"])

    return run


def _assigned(pivots, pairs, centroids):
    def run(batches):
        bounds = Bounds(pivots, pairs, centroids)
        for batch in batches:
            at, best, _ = nearest(*_batch(batch, len(pivots)), centroids, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array([int(v) if v < 1 << 63 else None for v in best], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE, settled: int = SETTLED) -> tuple[DataFrame | None, list[list[int]], list[dict]]:
    """(vec_id, cluster, distance) or None without vectors, the final centroids, and per round what was computed of all distances."""
    vectors = integers(embeddings, dimensions, scale)
    first = pivots = centroids = first_centroids(vectors, clusters, seed)
    if not pivots:
        return None, [], []
    cached = lambda: materialise(vectors.select("vec_id", "x").mapInArrow(_with_pivots(pivots), "vec_id long, x array<double>, near array<double>"), "ptolemaic-vectors")
    vectors, pairs = cached(), list(combinations(range(len(first)), 2))
    work = []
    for k in range(rounds):
        if k == settled:
            old, pivots, pairs = vectors, centroids + first, [(i, len(first) + (i + j) % len(first)) for i in range(len(first)) for j in range(min(2, len(first)))]
            vectors = cached()
            discard(old)
        sums = vectors.mapInArrow(_sums(pivots, pairs, centroids), "cluster int, component int, high decimal(38,0), low decimal(38,0)").groupBy("cluster", "component").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        total = {(r["cluster"], r["component"]): int(r["high"]) * PART + int(r["low"]) for r in sums.collect()}  # clusters x (dimensions + 2)
        n = [total[c, -2] for c in range(len(centroids))]
        work.append({"computed": total[0, -1], "all": sum(n) * len(centroids)})
        centroids = [[total[c, i] // n[c] for i in range(dimensions)] if n[c] else as_was for c, as_was in enumerate(centroids)]
    return vectors.mapInArrow(_assigned(pivots, pairs, centroids), "vec_id long, cluster int, distance long"), centroids, work


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    return summary(table(spark, sf_dir, "embeddings"))


def summary(embeddings: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    found, centroids, _ = cluster(embeddings, **settings)
    spark = embeddings.sparkSession
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = materialise(found, "ptolemaic-clusters")
    each = found.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total"))
    sums = {r["cluster"]: None if r["total"] is None else int(r["total"]) for r in each.collect()}  # a row a cluster
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    whole = None if None in sums.values() else sum(sums.values())
    names = [(c, fits(s), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    names = spark.createDataFrame(names, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(names), F.col("cluster") == F.col("_cluster"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql() -> str:
    """Each round as two tables: the assignment and the centroids that follow from it."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
          WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "e AS MATERIALIZED (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v)",
        f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), x) - 1 AS c, r FROM v QUALIFY c < {CLUSTERS})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN e USING (r))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, min(d * 16 + c) % 16 AS c, min(d * 16 + c) // 16 AS d FROM (SELECT e.r, t.c, sum((e.x - t.x) * (e.x - t.x))::HUGEINT AS d FROM e JOIN c{k} t USING (i) GROUP BY e.r, t.c) GROUP BY r)")
        if k < ROUNDS:
            steps.append(f"""m{k} AS MATERIALIZED (SELECT c, i, (t - ((t % n) + n) % n) // n AS x FROM (SELECT a.c, e.i, sum(e.x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM e JOIN a{k} a USING (r) GROUP BY a.c, e.i))""")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, t.x) AS x FROM c{k} t LEFT JOIN m{k} m USING (c, i))")
    last = ROUNDS
    return f"""WITH {', '.join(steps)}, h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{last} GROUP BY c)
      SELECT v.vec_id, a.c::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
      FROM a{last} a JOIN v USING (r) JOIN h USING (c)"""


OP12_SQL = _op12_sql()
