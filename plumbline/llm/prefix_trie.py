"""Prefix trie of conversations, built and searched as a z-fast trie.

A conversation is a string over turns. A compacted node stands for a path without
branches or ends: its extent is the whole string down to its branch or end, its name
that of its parent's extent plus one turn. It is stored under its handle, the prefix
of its extent whose length is the two-fattest number between the lengths of its
parent's extent and of its own (the number divisible by the greatest power of two).
Prefixes are known by 128-bit hashes: the exclusive or, over their turns, of a hash of
the turn's SHA-256 and place, so that all prefixes of a conversation are one running
aggregate.

A fat binary search finds a conversation's exit node in as many probes as its length
has binary digits: it looks up the prefix at the two-fattest number of the interval
that is left. A hit whose extent the conversation shares goes on below that extent, any
other hit is the exit node, below its parent's extent, and a miss goes on above the
probe. A last look-up by name finds the child into which a conversation leaves the
lowest shared extent. Each
probe is an equi-join of all pending conversations with the table of nodes.

Conversations are inserted in batches. Each pending one finds its exit node and
where it leaves that node's extent; edges are split there. Of all that go on by the same
turn from the same place, one, picked by hash, becomes a new leaf; the others are
the next batch and search on from there. A conversation waits only where a path
picked from its own subtree left its own, so the number of batches grows
with the logarithm of the number of conversations, not with their length.

Subtree sums need no level-by-level pass. A conversation's end is a node; the extents
on its path are found by one equi-join, and what a node adds to its ancestors is summed
along the path of its smallest member. Last, edges are expanded to a node a turn.

Equal conversations are counted first and inserted once. Windows run over the turns
of one conversation, which Spark spills; while it is inserted a conversation carries 16
bytes a turn. Ids of members that end at a node are hashed as a stream of blocks
in order of number.

Nulls and edges: a null role or text is empty; rows with equal turns are ordered by the
digests of role and text; rows without conv_id belong to no conversation and are left
out; repeated rows are turns like others; a conversation without turns ends at the
root; an empty table has no nodes. Columns besides conv_id, turn, role, text are
ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, materialise, table

FAMILY = 5
SHARED = 9
BLOCK = 256
NODE = ("e", "eh", "eg")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place from 0), symbol (SHA-256 of role and text) and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.sha2(F.concat(F.sha2(role, 256), text), 256).alias("symbol"), F.octet_length(text).cast("long").alias("bytes"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "symbol")
    return rows.select("conv_id", (F.row_number().over(w) - 1).alias("at"), "symbol", "bytes")


def rebuilt(rows: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Turns of each conversation with its head taken from the first of its family, and conv_id, len of all."""
    each = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = each.select(F.col("conv_id").alias("of"), F.col("n").alias("of_n"))
    c = F.col("conv_id")
    plan = each.select("conv_id", "n", (c - c % family).alias("head"), F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(shared)).alias("h"))
    plan = plan.join(heads, F.col("head") == F.col("of"), "left").select("conv_id", "head", "h", F.least("h", F.coalesce("of_n", F.lit(0))).alias("take"), "n")
    plan = materialise(plan.withColumn("len", F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-plan")
    own = rows.join(plan.select(c.alias("c"), "h", "take"), (c == F.col("c")) & (F.col("at") >= F.col("h"))).select("conv_id", (F.col("at") - F.col("h") + F.col("take")).alias("at"), "symbol", "bytes")
    lent = rows.where(F.col("at") < shared).withColumnRenamed("conv_id", "lender").join(plan.where("take > 0").select("conv_id", "head", "take"), (F.col("lender") == F.col("head")) & (F.col("at") < F.col("take")))
    return own.unionByName(lent.select("conv_id", "at", "symbol", "bytes")), plan.select("conv_id", "len")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, d, h, g, upto: hash and text bytes of each prefix of d turns."""
    w = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = lambda *c: F.bit_xor(F.xxhash64(*c)).over(w)
    return rows.select("conv_id", (F.col("at") + 1).cast("int").alias("d"), hashed("symbol", "at").alias("h"), hashed("at", "symbol").alias("g"), F.sum("bytes").over(w).alias("upto"))


def two_fattest(low: str, high: str) -> str:
    """SQL of the number in (low, high] that is divisible by the greatest power of two."""
    digits = f"length(bin(({low}) ^ ({high}))) - 1"
    return f"shiftleft(shiftright({high}, {digits}), {digits})"


def with_handles(edges: DataFrame) -> DataFrame:
    """edges (p: length of the parent's extent; path: h, g, upto of each turn below it) as nodes with extent, name and handle."""
    at = lambda i: F.element_at("path", F.expr(i))
    out = edges.withColumn("e", F.col("p") + F.size("path")).withColumn("f", F.expr(two_fattest("p", "e")))
    ends = {"n": at("1"), "f": at("f - p"), "e": at("size(path)")}
    return out.select("p", "e", "f", *[x[lane].alias(f"{k}{lane}") for k, x in ends.items() for lane in ("h", "g")], "path")


def exits(pending: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """pending (cid, a: length of a shared extent, path) with the exit node's p, e, extent hash and path, or nulls.

    A conversation whose search is over probes nothing; its key is a hash of its own,
    so that such rows do not meet in one task.
    """
    rows = pending.withColumns({"b": F.size("path"), "done": F.lit(False)})
    nothing = F.xxhash64("cid", "a", "b")
    for _ in range(longest.bit_length() if nodes is not None else 0):
        rows = rows.withColumn("probe", F.when(~F.col("done") & (F.col("a") < F.col("b")), F.expr(two_fattest("a", "b"))))
        key = F.try_element_at("path", "probe")
        rows = rows.withColumns({"kh": F.coalesce(key["h"], nothing), "kg": key["g"]})
        found = nodes.select(F.col("f").alias("_f"), F.col("fh").alias("_fh"), F.col("fg").alias("_fg"), F.col("p").alias("_p"), F.col("e").alias("_e"), F.col("eh").alias("_eh"), F.col("eg").alias("_eg"))
        rows = rows.join(found, (F.col("kh") == F.col("_fh")) & (F.col("kg") == F.col("_fg")) & (F.col("probe") == F.col("_f")), "left")
        end = F.try_element_at("path", F.col("_e"))
        whole = F.coalesce((end["h"] == F.col("_eh")) & (end["g"] == F.col("_eg")), F.lit(False))
        hit = F.col("_e").isNotNull()
        rows = rows.select("cid", "path", F.when(hit & whole, F.col("_e")).when(hit, F.col("_p")).otherwise(F.col("a")).alias("a"), F.when(F.col("probe").isNotNull() & ~hit, F.col("probe") - 1).otherwise(F.col("b")).alias("b"), (F.col("done") | hit & ~whole).alias("done"))
    name = F.try_element_at("path", F.col("a") + 1)
    rows = rows.withColumns({"kh": F.coalesce(name["h"], nothing), "kg": name["g"]})
    child = nodes.select(F.col("p").alias("xp"), F.col("e").alias("xe"), F.col("eh").alias("xh"), F.col("eg").alias("xg"), F.col("nh").alias("_nh"), F.col("ng").alias("_ng"), F.col("path").alias("edge"))
    rows = rows.join(child, (F.col("kh") == F.col("_nh")) & (F.col("kg") == F.col("_ng")) & (F.col("a") == F.col("xp")), "left")
    return rows.select("cid", "path", "a", "xp", "xe", "xh", "xg", "edge")


def insert(pending: DataFrame, nodes: DataFrame | None, longest: int) -> tuple[DataFrame, DataFrame]:
    """One batch: the nodes after it, and the conversations that wait for the next."""
    if nodes is None:
        found = pending.withColumns({"leave": F.col("a"), "xe": F.lit(None).cast("int"), "xh": F.lit(None).cast("long"), "xg": F.lit(None).cast("long")})
    else:
        alike = F.size(F.filter(F.zip_with("edge", F.slice("path", F.col("a") + 1, F.size("edge")), lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))), lambda same: same))
        found = exits(pending, nodes, longest).withColumn("leave", F.when(F.col("xe").isNotNull(), F.col("xp") + alike).otherwise(F.col("a")))
    found = materialise(found.select("cid", "path", F.col("leave").cast("int").alias("a"), "xe", "xh", "xg"), "trie-exits")
    goes_on = found.where(F.size("path") > F.col("a")).withColumns({"branch": F.element_at("path", F.col("a") + 1)})
    chosen = goes_on.groupBy(F.col("a").alias("_a"), F.col("branch.h").alias("_h"), F.col("branch.g").alias("_g")).agg(F.min(F.struct(F.xxhash64("cid").alias("r"), "cid")).alias("first"))
    chosen = materialise(chosen.select(F.col("first.cid").alias("_cid")), "trie-chosen")
    leaves = goes_on.join(chosen, F.col("cid") == F.col("_cid")).select(F.col("a").alias("p"), F.slice("path", F.col("a") + 1, F.size("path") - F.col("a")).alias("path"))
    edges = leaves
    if nodes is not None:
        cuts = found.where("xe > a").groupBy(*[F.col(x).alias(f"_{x}") for x in ("xe", "xh", "xg")]).agg(F.collect_set("a").alias("cuts"))  # no more than the edge is long
        old = nodes.join(cuts, (F.col("e") == F.col("_xe")) & (F.col("eh") == F.col("_xh")) & (F.col("eg") == F.col("_xg")), "left")
        stops = F.array_sort(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("e")))
        old = old.withColumn("start", F.col("p")).select("start", "path", F.posexplode(F.arrays_zip(F.concat(F.array("p"), stops).alias("low"), stops.alias("high"))).alias("i", "x")).where("x.high is not null")
        edges = leaves.unionByName(old.select(F.col("x.low").alias("p"), F.slice("path", F.col("x.low") - F.col("start") + 1, F.col("x.high") - F.col("x.low")).alias("path")))
    waiting = goes_on.join(chosen, F.col("cid") == F.col("_cid"), "left_anti").select("cid", "a", "path")
    after, waiting = materialise(with_handles(edges), "trie-nodes"), materialise(waiting, "trie-waiting")
    discard(found, chosen)
    return after, waiting


def compacted(distinct: DataFrame, longest: int) -> DataFrame:
    """The nodes of the trie over distinct conversations (cid, path): p, e, f, hashes of name, handle and extent, path of the edge."""
    nodes, waiting = None, distinct.where(F.size("path") > 0).select("cid", F.lit(0).alias("a"), "path")
    while nodes is None or not waiting.isEmpty():
        before = (nodes, waiting)
        nodes, waiting = insert(waiting, nodes, longest)
        discard(*[x for x in before if hasattr(x, "written")])
    return nodes


def _chained(batches):
    """e, eh, eg and the SHA-256 of the blocks of each node, which follow each other."""
    kinds = {"e": pa.int32(), "eh": pa.int64(), "eg": pa.int64(), "sha": pa.string()}
    flushed = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))
    now, state, out = None, None, []
    for batch in batches:
        for *key, block in zip(*(batch.column(c).to_pylist() for c in (*NODE, "block")), strict=True):
            if key != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(block.encode())
        if len(out) > 10_000:
            yield flushed()
            out.clear()
    if now:
        out.append((*now, state.hexdigest()))
        yield flushed()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node (conv_id, e, eh, eg), ascending and joined by commas."""
    blocks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / BLOCK).alias("place")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("block"))  # at most BLOCK ids
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "place").mapInArrow(_chained, "e int, eh long, eg long, sha string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = materialise(turns(conversations), "trie-turns")
    again, lengths = rebuilt(rows, family, shared)
    upto = materialise(prefixes(again), "trie-prefixes")
    # equal conversations: the smallest id stands for all
    last = upto.select(F.col("conv_id").alias("_c"), "d", "h", "g")
    ends = lengths.join(last, (F.col("conv_id") == F.col("_c")) & (F.col("len") == F.col("d")), "left")
    zero = F.lit(0).cast("long")
    ends = materialise(ends.select("conv_id", F.col("len").cast("int").alias("e"), F.coalesce("h", zero).alias("eh"), F.coalesce("g", zero).alias("eg")), "trie-ends")
    distinct = materialise(ends.groupBy(*NODE).agg(F.min("conv_id").alias("cid"), F.count("*").alias("copies")), "trie-distinct")
    longest = distinct.agg(F.max("e")).first()[0]
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if longest is None:
        return conversations.sparkSession.createDataFrame([], schema)
    kept = upto.join(distinct.select("cid"), F.col("conv_id") == F.col("cid"), "left_semi")
    paths = kept.groupBy(F.col("conv_id").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("d", "h", "g", "upto"))).alias("path")).select("cid", F.transform("path", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"), x["upto"].alias("upto"))).alias("path"))
    nodes = compacted(materialise(paths, "trie-paths"), longest) if longest else None
    # the nodes on the path of each conversation, the root first
    root = distinct.select("cid", F.lit(0).alias("e"), zero.alias("eh"), zero.alias("eg"), zero.alias("upto"))
    on_path = root
    if nodes is not None:
        extents = nodes.select(*[F.col(c).alias(f"_{c}") for c in NODE])
        steps = kept.select(F.col("conv_id").alias("cid"), F.col("d").alias("e"), F.col("h").alias("eh"), F.col("g").alias("eg"), "upto")
        on_path = root.unionByName(steps.join(extents, (F.col("e") == F.col("_e")) & (F.col("eh") == F.col("_eh")) & (F.col("eg") == F.col("_eg")), "left_semi"))
    on_path = materialise(on_path.join(distinct.select(F.col("cid").alias("_cid"), "copies"), F.col("cid") == F.col("_cid")).drop("_cid"), "trie-on-path")
    sums = on_path.groupBy(*[F.col(c).alias(f"_{c}") for c in NODE]).agg(F.sum("copies").alias("n_convs"), F.min("cid").alias("first"), F.count("*").alias("passing"))
    met = on_path.join(sums, (F.col("e") == F.col("_e")) & (F.col("eh") == F.col("_eh")) & (F.col("eg") == F.col("_eg"))).drop("_e", "_eh", "_eg")
    down, up = Window.partitionBy("cid").orderBy("e"), Window.partitionBy("cid").orderBy(F.col("e").desc())
    met = met.withColumns({f"p_{c}": F.lag(c).over(down) for c in (*NODE, "first", "upto")})
    own = F.when(F.col("cid") == F.col("first"), (F.col("n_convs") - 1) * (F.col("upto") - F.coalesce("p_upto", zero))).otherwise(0)
    met = met.withColumns({"leaf": (F.first("passing").over(up) == 1).cast("long"), "saved": F.sum(own).over(up)})
    chosen = lambda c: F.max(F.when(F.col("cid") == F.col("first"), F.col(c))).alias(c)
    full = met.groupBy(*NODE).agg(*[chosen(c) for c in ("n_convs", "first", "p_e", "p_eh", "p_eg", "p_first", "p_upto")], F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved"))
    full = materialise(full, "trie-sums")
    children = full.where("e > 0").groupBy(*[F.col(f"p_{c}").alias(f"_{c}") for c in NODE]).agg(F.count("*").alias("children"))
    same = (F.col("e") == F.col("_e")) & (F.col("eh") == F.col("_eh")) & (F.col("eg") == F.col("_eg"))
    full = full.join(children, same, "left").drop("_e", "_eh", "_eg")
    full = full.join(end_digests(ends).select(*[F.col(c).alias(f"_{c}") for c in NODE], "sha"), same, "left").drop("_e", "_eh", "_eg")
    # edges expanded: a node a turn, of which the last is the compacted one
    top = full.where("e = 0").withColumns({"i": F.lit(0), "before": zero})
    below = full.where("e > 0")
    if nodes is not None:
        below = below.join(nodes.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.transform("path", lambda x: x["upto"]).alias("path")), same).select("*", F.posexplode(F.slice(F.concat(F.array("p_upto"), "path"), F.lit(1), F.size("path"))).alias("i", "before")).drop("_e", "_eh", "_eg", "path")
        top = top.unionByName(below)
    is_last, is_first = (F.col("e") == 0) | (F.col("depth") == F.col("e")), F.col("i") == 0
    out = top.withColumn("depth", F.when(F.col("e") == 0, 0).otherwise(F.col("p_e") + F.col("i") + 1))
    return out.select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(is_first, F.col("p_first")).otherwise(F.col("first")).alias("parent_conv_id"), "n_convs",
        F.when(is_last, F.coalesce("children", zero)).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("before") - F.coalesce("p_upto", zero))).alias("saved_tokens"),
        F.when(is_last & F.col("sha").isNotNull(), F.col("sha")).otherwise(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"
OP11_SQL = f"""WITH s AS (SELECT conv_id AS c, turn, sha256(coalesce(role, '')) || coalesce(text, '') AS word, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
  t AS (SELECT c, list(sha256(word) ORDER BY turn NULLS FIRST, sha256(word)) AS w, list(bytes ORDER BY turn NULLS FIRST, sha256(word)) AS b FROM s GROUP BY c),
  r AS (SELECT t.c, {CRC32_SQL.replace("(c::", "(t.c::")} % {SHARED} AS h, coalesce(d.w, []) AS dw, coalesce(d.b, []) AS db, t.w, t.b FROM t LEFT JOIN t d ON d.c = t.c - t.c % {FAMILY}),
  q AS (SELECT c, list_concat(dw[1:h], w[h + 1:]) AS w, list_concat(db[1:h], b[h + 1:]) AS b FROM r),
  p AS (SELECT c, len(w) AS n, unnest(range(0, len(w) + 1)) AS d, w, b FROM q),
  m AS MATERIALIZED (SELECT c, n, d, sha256(array_to_string(w[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(w[1:d - 1], ',')) END AS pk, coalesce(b[d], 0) AS bytes FROM p),
  g AS MATERIALIZED (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, bool_and(n = d) AS leaf, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM m GROUP BY d, k),
  a AS (SELECT u.d, u.k, m2.d AS ad, m2.k AS ak, u.leaf, (u.n_convs - 1) * u.bytes AS saved FROM g u JOIN m m2 ON m2.c = u.conv_id AND m2.d <= u.d),
  x AS (SELECT ad AS d, ak AS k, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY ad, ak),
  e AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY d, pk)
  SELECT g.conv_id, g.d::BIGINT AS depth, o.conv_id AS parent_conv_id, g.n_convs, coalesce(e.n_children, 0) AS n_children, x.n_leaves, x.saved_tokens, sha256(g.ends) AS ends_sha256
  FROM g JOIN x USING (d, k) LEFT JOIN e USING (d, k) LEFT JOIN g o ON o.d = g.d - 1 AND o.k = g.pk"""
