"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors of a label collapse to one class with a count.
2. Clusters: k-means centres, fitted in tasks on at most ``sample_rows`` vectors of each
   (label, length), cut the classes into shards that overlap: a vector belongs to the
   ``overlap`` nearest. What has more than ``block_rows`` is split again in the same way,
   level by level, into shards of about ``shard_rows`` that do not grow with the table.
3. A *core* is a cluster so tight that any two of its members link, as each is within
   half of the link angle of its centre. Links inside a core are counted, not searched;
   vectors outside that may reach into it, by its angle, are compared with its members
   block by block. So a group of near copies costs what its size costs, not its square.
   Only the rest is in shards.
4. Each shard (in blocks of ``block_rows`` where it cannot be split) builds a graph by
   greedy insertion: in batches that double, every vector searches the graph so far
   with a beam, its candidates go through robust pruning (a candidate is dropped when
   an accepted one is ``alpha`` times nearer to it than the vector is), and edges back
   are pruned again where a list overflows. Two edges of each vector lead far away.
5. The adjacency lists that a vector got in its shards are united: one flat graph.
6. Range-expanding greedy search: the vectors of a shard start from its medoid, follow
   the flat graph's edges with a beam, and expand everything in range until nothing
   new is found. A pair counts in the smallest shard that both vectors share, so that
   each pair counts once and no pair leaves its task: tasks return link counts and stars.
7. Found pairs are verified by cosine in double precision, in the search itself.
8. The audit asks every class with a vec_id divisible by 100 and counts its links to
   other classes by brute force, in passes of ``audit_block`` classes over the table. As
   each found pair is verified and counts once, the share of the counts is the share of
   the pairs. Below ``recall``, over all links or as the mean of the classes that have
   links, the search runs again with twice the overlap; if it still falls short beyond
   ``most_overlap``, all pairs of a label are compared by blocks. The recall that was
   reached is the column audit_recall.

Only vectors of equal label and length are compared. A vector that is null, zero
or holds null or non-finite components, or has a null label, links with nothing
and is its own component. Rows that repeat a vec_id are vectors of their own that
share a component id; a null vec_id takes part and is named by null only when it is
alone. An empty table gives an empty result. Columns besides vec_id, embedding and
label are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, roots
from .shared import discard, materialise, table
from .vamana import build_graph, search_graph

LINKS = "rep long, n long, others long, root long"


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose rows have one length; scaled first, as squares may over- or underflow."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-323)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(batches, key: str):
    """Tables of the rows with one key, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                if held and keys[first] != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = keys[first]
                held.append(batch.slice(first, i - first))
                first = i
    if held:
        yield pa.Table.from_batches(held)


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    return centers


def _apart(centers: np.ndarray, at_least: float) -> np.ndarray:
    """The centers, in their order, without those that are as near to an earlier one as linked vectors are."""
    kept = np.zeros(len(centers), dtype=bool)
    sims = centers @ centers.T
    for i in range(len(centers)):
        kept[i] = not (sims[i, kept] >= at_least).any()
    return centers[kept]


def _cores(x: np.ndarray, centers: np.ndarray, half: float, at_least: float, least: int = 8) -> np.ndarray:
    """Centres of sample clusters of ``least`` members or more that lie within the half angle."""
    for _ in range(3):
        inside = centers @ x.T >= half
        centers = centers[inside.sum(axis=1) >= least]
        if not len(centers):
            return centers
        sums = (centers @ x.T >= half).astype(float) @ x
        centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    size = (centers @ x.T >= half).sum(axis=1)
    order = np.argsort(-size, kind="stable")
    return _apart(centers[order[size[order] >= least]], at_least)


def _fitter(at_least: float, half: float, overlap: int, shard_rows: int, fan: int, with_cores: bool):
    def run(batches):
        for sample in _groups(batches, "cell"):
            x, n = _vectors(sample["embedding"]), sample["n"][0].as_py()
            many = lambda share: max(4 * overlap, min(fan, math.ceil(n * share * overlap / shard_rows)))
            centers = _kmeans(x, many(1.0))
            cores = _cores(x, np.concatenate([centers, x[:fan]]), half, at_least) if with_cores else centers[:0]
            if len(cores):
                rest = x[(x @ cores.T).max(axis=1) < half]
                centers = _kmeans(rest, many(len(rest) / len(x))) if len(rest) else centers[:0]
            centers = _apart(centers, at_least)
            kinds = [True] * len(cores) + [False] * len(centers)
            yield pa.RecordBatch.from_arrays([pa.array([sample["cell"][0].as_py()] * len(kinds), pa.string()), pa.array(kinds), pa.array([*cores.tolist(), *centers.tolist()], pa.list_(pa.float64()))], ["cell", "is_core", "center"])

    return run


ASSIGNED = "rep long, copies long, embedding array<double>, cells array<string>, core string, near_cores array<string>"


def _assigner(overlap: int, half: float, wide: float):
    """For rows (cell, salt, kind, rep, copies, embedding), centres first: the next cells of each vector, its core, and other cores that it may reach."""

    def run(batches):
        now, cores, centers = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "kind")), strict=True))
            first = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[first]:
                    continue
                (cell, salt, kind), rows = keys[first], batch.slice(first, i - first)
                first = i
                if (cell, salt) != now:
                    now, cores, centers = (cell, salt), [], []
                if kind < 2:
                    (cores if kind == 0 else centers).extend(_vectors(rows.column("embedding")))
                    continue
                x = _vectors(rows.column("embedding"))
                core, near = [None] * len(x), [[] for _ in x]
                if cores:
                    sims = x @ np.array(cores).T
                    best = sims.argmax(axis=1)
                    inside = sims[np.arange(len(x)), best] >= half
                    core = [f"{cell}/{b}" if yes else None for b, yes in zip(best.tolist(), inside.tolist(), strict=True)]
                    for r, c in zip(*(a.tolist() for a in np.nonzero(sims >= wide)), strict=True):
                        if not (inside[r] and best[r] == c):
                            near[r].append(f"{cell}/{c}")
                if len(centers) > 1:
                    sims = x @ np.array(centers).T
                    k = max(1, min(overlap, len(centers) // 4))  # a shard has at most a share of the rows that shrinks with each level
                    cells = [[f"{cell}/{c}" for c in row] for row in np.argpartition(-sims, k - 1, axis=1)[:, :k].tolist()]
                else:
                    cells = [[f"{cell}!"]] * len(x)  # one centre: nothing to split
                yield pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("copies"), rows.column("embedding"), pa.array(cells, pa.list_(pa.string())), pa.array(core, pa.string()), pa.array(near, pa.list_(pa.string()))], ["rep", "copies", "embedding", "cells", "core", "near_cores"])

    return run


def _split(rows: DataFrame, sizes: DataFrame, level: int, at_least: float, overlap: int, shard_rows: int, sample_rows: int, fan: int) -> DataFrame:
    """rows (cell, rep, copies, embedding) of the cells in sizes (cell, n), assigned to the next level."""
    angle = math.acos(at_least)
    half, wide = math.cos(angle / 2) + 1e-9, math.cos(min(math.pi, 1.5 * angle)) - 1e-9
    rows = rows.join(sizes.withColumnRenamed("cell", "_cell"), F.col("cell") == F.col("_cell")).drop("_cell")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(level), "rep"), 11) / float(1 << 53)
    sample = rows.where(draw < sample_rows / F.col("n")).select("cell", "n", "embedding")  # about sample_rows of each cell
    centers = sample.repartition("cell").sortWithinPartitions("cell").mapInArrow(_fitter(at_least, half, overlap, shard_rows, fan, level == 0), "cell string, is_core boolean, center array<double>")
    centers = materialise(centers, "embedding-centers")
    salts = F.ceil(F.col("n") / 20_000).cast("int")  # rows of one cell are dealt to several tasks, its centres to each
    mine = rows.select("cell", F.pmod(F.xxhash64("rep"), salts).cast("int").alias("salt"), F.lit(2).alias("kind"), "rep", "copies", "embedding")
    theirs = centers.join(sizes.withColumnRenamed("cell", "_cell"), F.col("cell") == F.col("_cell"))
    theirs = theirs.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.when(F.col("is_core"), 0).otherwise(1).alias("kind"), F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("copies"), F.col("center").alias("embedding"))
    found = mine.unionByName(theirs).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return materialise(found.mapInArrow(_assigner(overlap, half, wide), ASSIGNED), "embedding-split")


def shards(classes: DataFrame, at_least: float, overlap: int, shard_rows: int, block_rows: int, sample_rows: int, fan: int) -> tuple[DataFrame, DataFrame | None]:
    """Vectors in shards (cell, rep, copies, embedding), and vectors in or near cores (rep, copies, embedding, core, near_cores)."""
    rows = classes.select(F.concat_ws("/", "label", F.size("embedding")).alias("cell"), "rep", "copies", "embedding")
    done, cores = None, None
    for level in range(20):
        sizes = materialise(rows.groupBy("cell").agg(F.count("*").alias("n")), "embedding-sizes")
        large = sizes.where((F.col("n") > block_rows) & ~F.col("cell").endswith("!"))
        if large.isEmpty():
            break
        small = rows.join(large.select(F.col("cell").alias("_cell")), F.col("cell") == F.col("_cell"), "left_anti")
        done = small if done is None else done.unionByName(small)
        found = _split(rows, large, level, at_least, overlap, shard_rows, sample_rows, fan)
        if level == 0:
            cores = found.where("core is not null or size(near_cores) > 0").select("rep", "copies", "embedding", "core", "near_cores")
            cores = None if cores.isEmpty() else cores
        rows = found.where("core is null").select(F.explode("cells").alias("cell"), "rep", "copies", "embedding")
    return rows if done is None else done.unionByName(rows), cores


def _counted(ids, n, others, src, dst):
    """Link counts by row, and stars of the links (src, dst), as one batch; rows without links are left out."""
    nodes, root = roots(src, dst)
    to = dict(zip(nodes.tolist(), root.tolist(), strict=True))
    some = sorted({*np.flatnonzero(others).tolist(), *np.flatnonzero(np.isin(ids, nodes)).tolist()})
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(others[some].astype(np.int64)), pa.array([to[v] for v in ids[some].tolist()], pa.int64())], ["rep", "n", "others", "root"])


def _across(at_least: float):
    """Links between the members and the others (is_base false) of a task, counted at both ends."""

    def run(batches):
        for group in _groups(batches, "task"):
            ids, copies, base = group["rep"].to_numpy(), group["copies"].to_numpy(), group["is_base"].to_numpy(zero_copy_only=False)
            x = _vectors(group["embedding"])
            mine, other = np.flatnonzero(base), np.flatnonzero(~base)
            found = x[other] @ x[mine].T >= at_least
            if found.any():
                n, others = np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
                n[other], n[mine] = found @ copies[mine], found.T @ copies[other]
                others[other], others[mine] = found.sum(axis=1), found.sum(axis=0)
                r, c = np.nonzero(found)
                yield _counted(ids, n, others, ids[other[r]], ids[mine[c]])

    return run


def core_links(cores: DataFrame, at_least: float, block_rows: int) -> DataFrame:
    """rep, n, others, root of the links with members of cores."""
    members = cores.where("core is not null")
    sums = materialise(members.groupBy("core").agg(F.sum("copies").alias("total"), F.count("*").alias("members"), F.min("rep").alias("least")).withColumnRenamed("core", "_core"), "embedding-cores")
    inside = members.join(sums, F.col("core") == F.col("_core")).select("rep", (F.col("total") - F.col("copies")).alias("n"), (F.col("members") - 1).alias("others"), F.col("least").alias("root"))
    # a pair of vectors of two cores counts at the lesser core
    near = cores.select("rep", "copies", "embedding", "core", F.explode("near_cores").alias("of")).where("core is null or core > of")
    asking = materialise(near.groupBy(F.col("of").alias("_of")).agg(F.count("*").alias("outside")), "embedding-near")
    sizes = sums.select("_core", "members").join(asking, F.col("_core") == F.col("_of"))
    sizes = sizes.select("_core", F.ceil(F.col("members") / block_rows).cast("int").alias("mine"), F.ceil(F.col("outside") / block_rows).cast("int").alias("theirs"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("with")
    base = members.join(sizes, F.col("core") == F.col("_core")).select("rep", "copies", "embedding", F.lit(True).alias("is_base"), "core", block("mine").alias("block"), upto("theirs"))
    base = base.withColumn("task", F.concat_ws("/", "core", "block", "with"))
    rest = near.join(sizes, F.col("of") == F.col("_core")).select("rep", "copies", "embedding", F.lit(False).alias("is_base"), "of", block("theirs").alias("block"), upto("mine"))
    rest = rest.withColumn("task", F.concat_ws("/", "of", "with", "block"))
    columns = ["rep", "copies", "embedding", "is_base", "task"]
    found = base.select(*columns).unionByName(rest.select(*columns)).repartition("task").sortWithinPartitions("task").mapInArrow(_across(at_least), LINKS)
    return materialise(inside.unionByName(found), "embedding-core-links")


def _builder(degree: int, alpha: float, beam: int):
    def run(batches):
        for block in _groups(batches, "block_key"):
            ids = block["rep"].to_numpy()
            near = build_graph(_vectors(block["embedding"]).astype(np.float32), degree, alpha, beam)
            has = near >= 0
            offsets = np.concatenate([[0], np.cumsum(has.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), block["shard"].combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[near[has]]))], ["rep", "shard", "near"])

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of all entries of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _searcher(at_least: float, beam: int, exact: bool):
    def run(batches):
        for group in _groups(batches, "task"):
            ids, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
            asks, base = np.flatnonzero(group["asks"].to_numpy(zero_copy_only=False)), np.flatnonzero(group["is_base"].to_numpy(zero_copy_only=False))
            if not len(asks) or not len(base):
                continue
            x = _vectors(group["embedding"])
            if exact:
                a, b = np.nonzero(x[asks] @ x[base].T >= at_least)
            else:
                owner, near = _lists(group["near"].take(pa.array(base)))
                order = np.argsort(ids[base])
                at = np.minimum(np.searchsorted(ids[base], near, sorter=order), len(base) - 1)
                here = ids[base][order[at]] == near  # the rest of the flat graph lies in other blocks
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[here], minlength=len(base)))])
                y = x.astype(np.float32)
                medoid = int((x[base] @ x[base].mean(axis=0)).argmax())
                _, (a, b) = search_graph(y[base], offsets, order[at[here]], y[asks], medoid, beam, at_least)
                sure = np.zeros(len(a), dtype=bool)
                for i in range(0, len(a), 100_000):
                    sure[i : i + 100_000] = np.einsum("ij,ij->i", x[asks[a[i : i + 100_000]]], x[base[b[i : i + 100_000]]]) >= at_least
                a, b = a[sure], b[sure]
            a, b = asks[a], base[b]
            owner, shard = _lists(group["shards"])
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            wide = np.full((len(ids), int(place.max()) + 1), np.iinfo(np.int64).max)
            wide[owner, place] = shard
            first = ids[a] != ids[b]
            for i in range(0, len(a), 100_000):
                p, q = wide[a[i : i + 100_000]], wide[b[i : i + 100_000]]
                common = np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, np.iinfo(np.int64).max).min(axis=1)
                first[i : i + 100_000] &= common == group["shard"][0].as_py()
            a, b = a[first], b[first]
            if len(a):
                yield _counted(ids, np.bincount(a, weights=copies[b], minlength=len(ids)), np.bincount(a, minlength=len(ids)), ids[a], ids[b])

    return run


def search(placed: DataFrame, at_least: float, block_rows: int, degree: int, alpha: float, beam: int, exact: bool = False) -> DataFrame:
    """Of vectors in shards (cell, rep, copies, embedding), per class that has links: rep, n (linked vectors of other classes), others (linked classes), root.

    exact: every pair of the blocks of a shard is compared without a graph.
    """
    placed = placed.select(F.xxhash64("cell").alias("shard"), "rep", "copies", "embedding")
    blocks = placed.groupBy(F.col("shard").alias("_shard")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    placed = placed.join(blocks, F.col("shard") == F.col("_shard")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("_shard")
    placed = materialise(placed, "embedding-shards")
    if exact:
        flat = placed.select(F.col("rep").alias("_rep"), F.array("shard").alias("shards"), F.array().cast("array<long>").alias("near"))
    else:
        built = placed.select("rep", "shard", "embedding", F.concat_ws("/", "shard", "block").alias("block_key")).repartition("block_key").sortWithinPartitions("block_key")
        built = built.mapInArrow(_builder(degree, alpha, beam), "rep long, shard long, near array<long>")
        flat = built.groupBy(F.col("rep").alias("_rep")).agg(F.collect_set("shard").alias("shards"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        flat = materialise(flat, "embedding-graph")  # a list of at most 2 * degree for each shard of a vector
    tasks = placed.withColumn("pair", F.explode(F.expr("array_distinct(flatten(transform(sequence(0, blocks - 1), i -> array(struct(block as asker, i as held), struct(i as asker, block as held)))))")))
    tasks = tasks.join(flat, F.col("rep") == F.col("_rep"))
    tasks = tasks.select("rep", "copies", "embedding", "near", "shards", "shard", (F.col("pair.asker") == F.col("block")).alias("asks"), (F.col("pair.held") == F.col("block")).alias("is_base"), F.concat_ws("/", "shard", "pair.asker", "pair.held").alias("task"))
    return materialise(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_searcher(at_least, beam, exact), LINKS), "embedding-links")


def audit(named: DataFrame, at_least: float, audit_block: int) -> float:
    """Share of the links to other classes that the search found for the classes that are asked: of all, or as the mean of classes if that is less."""
    asked = named.where("asked").select("_label", "_embedding", "others", "rep")
    passes = max(1, math.ceil(asked.count() / audit_block))
    found = links = mean = classes = 0.0
    for i in range(passes):
        some = asked.where(F.pmod(F.xxhash64(F.lit("audit"), "rep"), F.lit(passes)) == i).toPandas()  # about audit_block rows
        if not len(some):
            continue
        groups = {}
        for (label, length), g in some.groupby(["_label", some["_embedding"].map(len)]):
            groups[label, length] = g.index.to_numpy(), _vectors(pa.array(g["_embedding"].to_list(), pa.list_(pa.float64())))

        def count(batches, groups=groups):
            for batch in batches:
                keys = list(zip(batch.column("_label").to_pylist(), batch.column("_embedding").value_lengths().to_pylist(), strict=True))
                for key in set(keys) & set(groups):
                    ids, x = groups[key]
                    mine = pa.array([i for i, k in enumerate(keys) if k == key])
                    linked = (x @ _vectors(batch.column("_embedding").take(mine)).T >= at_least).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked.astype(np.int64))], ["id", "n"])

        true = named.select("_label", "_embedding").mapInArrow(count, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n")).where("n > 0").toPandas()
        met = some["others"].to_numpy()[true["id"].to_numpy(dtype=np.int64)]
        found, links, mean, classes = found + met.sum(), links + true["n"].sum(), mean + (met / true["n"].to_numpy()).sum(), classes + len(true)
    return float(min(found / links, mean / classes)) if links else 1.0


def near_duplicates(
    embeddings: DataFrame, at_least: float = 0.93, overlap: int = 2, shard_rows: int = 500, block_rows: int = 1500, sample_rows: int = 5000, fan: int = 250,
    degree: int = 12, alpha: float = 1.2, beam: int = 16, audit_block: int = 20_000, recall: float = 0.9, most_overlap: int = 16,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, audit_recall."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = F.expr("label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double)) and exists(embedding, x -> x <> 0)")
    rows = materialise(rows.withColumn("good", F.coalesce(good, F.lit(False))), "embedding-rows")
    usable = rows.where("good")
    no_name = F.lit((1 << 63) - 1)
    classes = usable.groupBy("label", "embedding").agg(F.min(F.coalesce("vec_id", no_name)).alias("name"), F.count("*").alias("copies"), F.coalesce(F.max(F.col("vec_id") % 100 == 0), F.lit(False)).alias("asked"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "embedding-classes")  # once written, the number stays
    while True:
        exact = overlap > most_overlap
        if exact:
            placed, cores = classes.select(F.concat_ws("/", "label", F.size("embedding")).alias("cell"), "rep", "copies", "embedding"), None
        else:
            placed, cores = shards(classes, at_least, overlap, shard_rows, block_rows, sample_rows, fan)
        found = search(placed, at_least, block_rows, degree, alpha, beam, exact)
        if cores is not None:
            found = found.unionByName(core_links(cores, at_least, block_rows))
        components = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
        links = found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("n").alias("n"), F.sum("others").alias("others"))
        named = classes.join(links, F.col("rep") == F.col("_rep"), "left").join(components, F.col("rep") == F.col("node"), "left")
        named = materialise(named.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "rep", "name", "copies", "asked", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "rep").alias("component")), "embedding-named")
        reached = 1.0 if exact else audit(named, at_least, audit_block)
        if reached >= recall:
            break
        overlap *= 2
    discard(classes)
    names = named.groupBy(F.col("component").alias("_component")).agg(F.min("name").alias("group"))
    found = usable.join(named, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).join(names, F.col("component") == F.col("_component"))
    found = found.select("vec_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "group")
    # rows that repeat a vec_id with other vectors pool their components
    pooled = found.where("vec_id is not null").groupBy("vec_id").agg(F.min("group").alias("src"), F.max("group").alias("dst")).where("src <> dst")
    if not usable.groupBy("vec_id").count().where("count > 1").isEmpty():
        pooled = connected_components(pooled)
        found = found.join(pooled, F.col("group") == F.col("node"), "left").withColumn("group", F.coalesce("component", "group"))
    found = found.select("vec_id", "n_links", F.nullif(F.col("group"), no_name).alias("component_id"))
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audit_recall", F.lit(reached))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
