"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

A document is the set of its distinct ``size``-word shingles (64-bit hashes of
ASCII-lower-cased words; a shorter text is one shingle). Two documents link when
100 * intersection >= ``percent`` * union.

1. Common shingles are counted where a batch meets them more than once; the most
   frequent ``hints`` of them end the global token order, all others come first,
   by hash. The order affects cost only.
2. Documents with equal sets collapse to the smallest doc_id. Of a set of n
   tokens the first n - t + l (t = ceil(percent * n / 100)) are its l-prefix, for
   l up to ``most_matches``. Linked sets share at least l tokens of both l-prefixes.
3. Prefix tokens are counted exactly; a token that nobody shares is dropped. Each
   document's prefix is lengthened by its estimated number of candidates, and a
   pair must share min(l, l') prefix tokens to become a candidate. Pairs are made
   for tokens that at most ``hot`` documents have in their prefix; the documents of
   other tokens are candidates of each other without being listed as pairs.
4. The components of this candidate graph are families; no link leaves one. Each
   family is read with its whole texts and verified exactly by sparse set products
   in groups of bounded size. A family of more than ``block_docs`` is dealt into
   blocks; every block is verified with about ``pivots`` documents of the whole
   family, which joins near copies of one text at a cost that is linear in their
   number. Then each listed pair of two components is compared, and for each token of
   more than ``hot`` documents those outside the token's greatest component with all
   that have it, block by block. Two documents of one component need no comparison.
   Tasks emit stars, not pairs.
5. The components of the verified links are the result; copies follow the
   document that they collapsed to.

Two sets are compared by the 64-bit hashes of their shingles (equal sets by 128 bits):
links are exact up to collisions of these.

Nulls and edges: a null or blank text has no shingle, links with nothing and is
its own component; rows that repeat a doc_id are one document whose links are
pooled (each row is returned with its own n_shingles); a null doc_id links with
nothing and has a null component; an empty table gives an empty result. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import EDGE, connected_components, roots
from .shared import among, materialise, table
from .wordhash import hash_words, shingles, text_chunks

SIGNATURE = "doc_id long, n long, set_id binary, tokens array<long>"


def text_sets(texts: pa.Array, size: int):
    for _, raw, bounds in text_chunks(texts):
        yield from shingles(*hash_words(raw, bounds), size)


def _common(size: int):
    def run(batches):
        texts = (batch.column("text").slice(row, 2500) for batch in batches for row in range(0, batch.num_rows, 2500))
        for some in texts:
            found, n = np.unique(np.concatenate(list(text_sets(some, size))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["token", "n"])

    return run


def _signatures(size: int, percent: int, most_matches: int, common: np.ndarray, frequency: np.ndarray):
    def run(batches):
        for batch in batches:
            sizes, ids, prefixes = [], [], []
            for tokens in text_sets(batch.column("text"), size):
                n = len(tokens)
                keep = min(n, n - -(-percent * n // 100) + most_matches)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    late = common[at] == tokens
                    first = tokens[~late][:keep]
                    if len(first) < keep:
                        first = np.concatenate([first, tokens[late][np.argsort(frequency[at[late]], kind="stable")][: keep - len(first)]])
                else:
                    first = tokens[:keep]
                sizes.append(n)
                ids.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                prefixes.append(first.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), tokens], ["doc_id", "n", "set_id", "tokens"])

    return run


def signatures(documents: DataFrame, size: int, percent: int, most_matches: int = 4, hints: int = 200_000) -> DataFrame:
    """doc_id, n, set_id and the tokens of the longest prefix of each row."""
    counted = documents.select("text").mapInArrow(_common(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where("n >= 16").orderBy(F.desc("n"), "token").limit(hints).toPandas()  # hints rows at most
    common = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(common)
    return materialise(documents.mapInArrow(_signatures(size, percent, most_matches, common[order], top["n"].to_numpy(dtype=np.int64)[order]), SIGNATURE), "ngram-signatures")


def candidates(sets: DataFrame, percent: int, most_matches: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listed candidate pairs (src, dst), edges that chain the documents of a hot token, and the hot tokens (token, doc) of prefixes.

    The components of pairs and edges together hold all links of sets (doc, n, tokens);
    linked documents are a listed pair, or have a hot token in common.
    """
    tokens = sets.select("doc", "n", F.posexplode("tokens").alias("at", "token"))
    tokens = tokens.select("token", "doc", "n", F.greatest(F.lit(1), F.col("at") + 1 - F.expr(f"n - ({percent} * n + 99) div 100")).cast("int").alias("level"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first")).where("n_docs > 1")
    postings = materialise(tokens.join(shared, "token"), "ngram-postings")
    chained = postings.where((F.col("n_docs") > hot) & (F.col("doc") > F.col("first"))).select(F.col("doc").alias("src"), F.col("first").alias("dst")).distinct()
    cold = postings.where(F.col("n_docs") <= hot)
    cost = cold.where("level = 1").groupBy(F.col("doc").alias("_doc")).agg(F.sum(F.col("n_docs") - 1).alias("cost"))
    # the prefix grows by one token for each factor of eight in the estimated candidates
    matches = F.least(F.lit(most_matches), 1 + F.floor(F.log(8.0, F.greatest("cost", F.lit(1)))), F.expr(f"({percent} * n + 99) div 100")).cast("int")
    cold = cold.join(cost, F.col("doc") == F.col("_doc")).withColumn("matches", matches).where("level <= matches")
    held = cold.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("doc", "n", "level", "matches"))).alias("docs"))  # at most hot in each
    pair = (
        "flatten(transform(docs, (a, i) -> transform(filter(slice(docs, i + 2, size(docs)), b -> a.doc < b.doc"
        f" and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
        " and greatest(a.level, b.level) <= least(a.matches, b.matches)), b -> struct(a.doc as src, b.doc as dst, least(a.matches, b.matches) as need))))"
    )
    pairs = held.where("size(docs) > 1").select(F.explode(F.expr(pair)).alias("p")).select("p.*")
    pairs = pairs.groupBy("src", "dst").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need").select("src", "dst")
    return materialise(pairs, "ngram-pairs"), chained, postings.where(F.col("n_docs") > hot).select("token", "doc")


def links(sets: list[np.ndarray], percent: int, strip: int = 256, cells: int = 4_000_000):
    """Pairs (a, b) of linked sets with a < b, in strips of rows; memory is of the order of len(sets)**2 + cells."""
    n = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owner, tokens = np.repeat(np.arange(len(sets), dtype=np.int32), n)[order], tokens[order]
    column = np.cumsum(np.concatenate([[True], tokens[1:] != tokens[:-1]])) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    if not len(column):
        return
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = max(1, min(int(column[-1]) + 1, cells // len(sets)))
    for first in range(0, int(column[-1]) + 1, step):
        a, b = np.searchsorted(column, [first, first + step])
        dense = np.zeros((len(sets), step), dtype=np.float32)
        dense[owner[a:b], column[a:b] - first] = 1
        for row in range(0, len(sets), strip):
            common[row : row + strip] += dense[row : row + strip] @ dense.T
    for row in range(0, len(sets), strip):
        both = common[row : row + strip].astype(np.float64)
        a, b = np.nonzero(100 * both >= percent * (n[row : row + strip, None] + n[None, :] - both))
        a = a + row
        yield a[a < b], b[a < b]


def _verified(size: int, percent: int):
    def stars(docs: list[int], texts: list[str]):
        ids = np.array(docs, dtype=np.int64)
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in links(list(text_sets(pa.array(texts, pa.large_string()), size)), percent):
            nodes, root = roots(ids[a], ids[b])
            src.append(nodes[nodes != root])
            dst.append(root[nodes != root])
        nodes, root = roots(np.concatenate(src), np.concatenate(dst))
        leaf = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(root[leaf])], ["src", "dst"])

    def run(batches):
        key, docs, texts = None, [], []
        for batch in (whole.slice(row, 1000) for whole in batches for row in range(0, whole.num_rows, 1000)):
            for now, doc, text in zip(*(batch.column(c).to_pylist() for c in ("group", "doc", "text")), strict=True):
                if now != key:
                    if len(docs) > 1:
                        yield stars(docs, texts)
                    key, docs, texts = now, [], []
                docs.append(doc)
                texts.append(text or "")
        if len(docs) > 1:
            yield stars(docs, texts)

    return run


def _stars(documents: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """Stars (src, dst) of the verified links within each group, a part of a family; dealt: doc, family, parts."""
    dealt = materialise(dealt, "ngram-dealt")
    dealt = dealt.select("doc", F.explode("parts").alias("part"), "family").select("doc", F.concat_ws("/", "family", "part").alias("group"))
    named = among(dealt, F.xxhash64("doc"))  # else every text would cross the network
    texts = documents.where("doc_id is not null").where(named(F.xxhash64("doc_id"))).join(dealt, F.col("doc_id") == F.col("doc")).select("group", "doc", "text")
    return materialise(texts.repartition("group").sortWithinPartitions("group").mapInArrow(_verified(size, percent), EDGE), "ngram-links")


def _uniform(salt: str, doc: str = "doc"):
    """A number in [0, 1) for a document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col(doc)), 11) / float(1 << 53)


def verify(documents: DataFrame, sets: DataFrame, families: DataFrame, pairs: DataFrame, hot_tokens: DataFrame, size: int, percent: int, block_docs: int = 500, block_shingles: int = 1_000_000, pivots: int = 48) -> tuple[DataFrame, bool]:
    """Stars (src, dst) of the verified links, and whether a family was dealt into blocks."""
    member = families.join(sets.select("doc", "n"), F.col("node") == F.col("doc")).select("doc", "n", F.col("component").alias("family"))
    blocks = member.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    blocks = blocks.withColumn("blocks", F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("total") / block_shingles)).cast("int"))
    blocks = materialise(blocks.select(F.col("family").alias("_family"), "docs", "blocks"), "ngram-blocks")
    member = materialise(member.join(blocks, F.col("family") == F.col("_family")).drop("_family"), "ngram-members")
    # a document lies in its block; the pivots of a family, by hash, in all of its blocks
    everywhere = (F.col("blocks") > 1) & (_uniform("pivot") < F.least(F.lit(pivots), F.col("docs") / F.col("blocks")) / F.col("docs"))
    at = F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.floor(_uniform("block") * F.col("blocks")).cast("int")))
    found = _stars(documents, member.select("doc", "family", at.alias("parts")), size, percent)
    large = member.where("blocks > 1")
    if large.isEmpty():
        return found, False
    joined = connected_components(found)
    large = large.join(joined, F.col("doc") == F.col("node"), "left").select("doc", "n", "family", F.coalesce("component", "doc").alias("component"))
    large = materialise(large, "ngram-large")
    needed = lambda docs, total: F.greatest(F.lit(1), F.ceil(docs / block_docs), F.ceil(total / block_shingles)).cast("int")
    # listed pairs of two components: a document meets its partners, in as many groups as they need
    end = lambda doc, name: large.select(F.col("doc").alias(doc), F.col("component").alias(f"{name}_component"), F.col("n").alias(f"{name}_n")).distinct()
    apart = materialise(pairs.join(end("src", "a"), "src").join(end("dst", "b"), "dst").where("a_component <> b_component").select("src", "dst", "b_n"), "ngram-apart")
    sizes = apart.groupBy("src").agg(needed(F.count("*"), F.sum("b_n")).alias("parts"))
    family = F.concat(F.lit("pair/"), F.col("src").cast("string")).alias("family")
    partners = apart.join(sizes, "src").select(F.col("dst").alias("doc"), family, F.array(F.floor(_uniform("pair", "dst") * F.col("parts")).cast("string")).alias("parts"))
    dealt = partners.unionByName(sizes.select(F.col("src").alias("doc"), family, F.sequence(F.lit(0), F.col("parts") - 1).cast("array<string>").alias("parts")))
    # hot tokens that documents of several components share
    shared = hot_tokens.select("token", F.col("doc").alias("_doc")).join(large, F.col("_doc") == F.col("doc")).select("token", "doc", "n", "component").distinct()
    shared = materialise(shared, "ngram-shared")
    open_ = shared.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select(F.col("token").alias("_token"))
    left = materialise(shared.join(open_, F.col("token") == F.col("_token")).drop("_token"), "ngram-open")
    sizes = left.groupBy("token", "component").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    greatest = F.max(F.struct("docs", "total", "component"))
    sizes = sizes.groupBy(F.col("token").alias("_token")).agg(greatest.alias("most"), F.sum("docs").alias("docs"), F.sum("total").alias("total"))
    sizes = sizes.select("_token", F.col("most.component").alias("most"), needed(F.col("docs"), F.col("total")).alias("holders"), needed(F.col("docs") - F.col("most.docs"), F.col("total") - F.col("most.total")).alias("askers"))
    left = left.join(sizes, F.col("token") == F.col("_token")).withColumn("asks", F.col("component") != F.col("most"))
    # a token's documents outside its greatest component meet all that have it: a group for each pair of a block of those that ask and a block of all
    mine = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("holders") - 1), lambda i: F.concat_ws("/", F.floor(_uniform("ask") * F.col("askers")), i))).otherwise(F.array().cast("array<string>"))
    held = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda i: F.concat_ws("/", i, F.floor(_uniform("hold") * F.col("holders"))))
    dealt = dealt.unionByName(left.select("doc", F.concat(F.lit("token/"), F.col("token").cast("string")).alias("family"), F.array_union(mine, held).alias("parts")))
    return found.unionByName(_stars(documents, dealt, size, percent)), True


def jaccard_components(documents: DataFrame, size: int = 5, percent: int = 80, most_matches: int = 4, hot: int = 64, block_docs: int = 500, pivots: int = 48) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = signatures(documents, size, percent, most_matches)
    known = rows.where("n > 0 and doc_id is not null")
    sets = materialise(known.groupBy("set_id", "n").agg(F.min(F.struct("doc_id", "tokens")).alias("x")).select("set_id", F.col("x.doc_id").alias("doc"), "n", F.col("x.tokens").alias("tokens")), "ngram-sets")
    pairs, chained, hot_tokens = candidates(sets, percent, most_matches, hot)
    stars, dealt = verify(documents, sets, connected_components(pairs.unionByName(chained)), pairs, hot_tokens, size, percent, block_docs=block_docs, pivots=pivots)
    copies = known.select("doc_id", "set_id").join(sets.select(F.col("set_id").alias("_set"), "doc"), F.col("set_id") == F.col("_set"))
    # rows that repeat a doc_id with other texts pool their links
    pooled = copies.where("doc_id <> doc").groupBy("doc_id").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most")
    if dealt or not pooled.isEmpty() or not sets.groupBy("doc").count().where("count > 1").isEmpty():
        extra = copies.where("doc_id <> doc").select(F.col("doc_id").alias("src"), F.col("doc").alias("dst")) if not dealt or not pooled.isEmpty() else None
        found = connected_components(stars if extra is None else stars.unionByName(extra))
    else:
        found = stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    named = copies.select(F.col("doc_id").alias("_id"), "doc").distinct().join(found, F.col("doc") == F.col("node"), "left").groupBy("_id").agg(F.min(F.least("doc", F.coalesce("component", "doc"))).alias("component"))
    return rows.select("doc_id", "n").join(named, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def keep_first(documents: DataFrame, **options) -> DataFrame:
    """The rows of documents that are the first of their group, or in none."""
    stays = jaccard_components(documents.select("doc_id", "text"), **options).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.struct("*").alias("row"))
    return rows.join(stays, "id", "left_semi").unionByName(rows.where("id is null")).select("row.*")
