import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from plumbline.llm import components, embedding_dedup, registry, vamana, warc
from plumbline.llm.shared import fresh_path


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(500)] + [(2000 + i, 2001 + i) for i in range(60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    for at_once in (0, 100_000):
        assert {tuple(r) for r in components.connected_components(df, at_once=at_once).collect()} == set(label.items())
    assert components.connected_components(df.limit(0)).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in range(3):
        base = rng.normal(size=(60, 16))
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(base)]
        rows += [(len(rows) + i, (base[0] + 0.12 * rng.normal(size=16)).tolist(), label) for i in range(70)]
    rows += [(900, [0.0] * 16, 1), (901, None, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, rows[0][1], 0), (905, rows[0][1], 0), (906, [float("inf")] + [1.0] * 15, 0), (907, [1.0, 2.0], 0), (908, [1.0, 2.0], 0), (None, [3.0, -1.0], 0)]
    return rows


def brute_links(rows, at_least):
    good = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = defaultdict(list)
    for a, (i, x, p) in enumerate(good):
        for b, (j, y, q) in enumerate(good):
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= at_least:
                links[i, a].append(j)
    label = {i: i for i, *_ in rows if i is not None}
    for _ in range(200):
        for (i, _), others in links.items():
            for j in others:
                if i is not None and j is not None:
                    label[i] = label[j] = min(label[i], label[j])
    return sorted((len(links.get((i, a), [])), label[i]) for a, (i, *_) in enumerate(good) if i is not None), label


def test_embedding_dedup_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as copies", "'x' as shard")
    wanted, label = brute_links(rows, 0.93)
    for options in ({}, {"shard_rows": 30, "block_rows": 60}):
        found = embedding_dedup.near_duplicates(df, **options).collect()
        assert len(found) == len(rows)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
        usable = [r for r in found if r["vec_id"] is not None and r["vec_id"] not in (900, 901, 902, 903, 904, 906)]
        assert sum(r["n_links"] for r in usable) >= 0.95 * sum(n for n, _ in wanted)
        if not options:
            assert sorted((r["n_links"], r["component_id"]) for r in usable) == wanted
        assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found if r["vec_id"] in (900, 901, 902, 903, 904, 906)} == {(i, 0, i) for i in (900, 901, 902, 903, 904, 906)}
        assert [r["component_id"] for r in found if r["vec_id"] is None] == [None]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_audit_is_not_met_by_copies(spark):
    rng = np.random.default_rng(3)
    one, pairs = rng.normal(size=16), rng.normal(size=(150, 16))
    rows = [(100 * i, one.tolist(), 1) for i in range(200)]
    rows += [(100_000 + 100 * i + j, (v + 0.01 * j).tolist(), 1) for i, v in enumerate(pairs) for j in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wanted = dict(zip([r[0] for r in rows], ((x @ x.T >= 0.93).sum(axis=1) - 1).tolist(), strict=True))
    # beyond the greatest overlap all pairs are compared
    found = embedding_dedup.near_duplicates(df, most_overlap=0).collect()
    assert {r["vec_id"]: r["n_links"] for r in found} == wanted
    # copies alone give 39,800 links, yet a search that finds none of the 150 others is seen
    named = [(1, one.tolist(), 0, True, 0)] + [(1, v, i, i % 2 == 0, 0 if i % 100 else 1) for i, v in enumerate(r[1] for r in rows[200:])]
    named = spark.createDataFrame(named, "_label long, _embedding array<double>, rep long, asked boolean, others long")
    assert embedding_dedup.audit(named, 0.93, 40) == pytest.approx(3 / 150)


def test_embedding_dedup_of_many_vectors_against_brute_force(spark):
    rng = np.random.default_rng(11)
    label = np.repeat([0, 1, 2], [14_000, 5_000, 1_000])
    x = rng.normal(size=(20_000, 32))
    x[:1500] = x[0] + 0.12 * rng.normal(size=(1500, 32))  # a hot group of near copies
    x[5000:5500] = x[5000] + 0.25 * rng.normal(size=(500, 32))  # and one too wide for a core
    x[6000:6100] = x[0] + 0.33 * rng.normal(size=(100, 32))  # around the hot group
    x[6100:9100:2] = x[6101:9101:2] + 0.15 * rng.normal(size=(1500, 32))  # pairs
    x[14_000:14_300] = x[14_000] + 0.1 * rng.normal(size=(300, 32))
    x[19_000] *= 1e-300
    x[19_001] *= 1e300
    ids = rng.permutation(20_000) * 3
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, label, strict=True)], "vec_id long, embedding array<double>, label int").repartition(6)
    found = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").loc[ids]
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    n, low = np.zeros(20_000, np.int64), np.arange(20_000)
    src, dst = [], []
    for k in range(3):
        at = np.flatnonzero(label == k)
        for row in range(0, len(at), 1000):
            a, b = np.nonzero(unit[at[row : row + 1000]] @ unit[at].T >= 0.93)
            n += np.bincount(at[a + row], minlength=20_000)
            src.append(at[a + row])
            dst.append(at[b])
    n -= 1
    nodes, root = components.roots(ids[np.concatenate(src)], ids[np.concatenate(dst)])
    got = found["n_links"].to_numpy()
    assert (got <= n).all() and got.sum() >= 0.99 * n.sum() and (got / np.maximum(n, 1))[n > 0].mean() >= 0.97
    right = dict(zip(nodes.tolist(), root.tolist(), strict=True))
    assert np.mean([c == right[i] for i, c in zip(ids.tolist(), found["component_id"].tolist(), strict=True)]) >= 0.99
    assert (found["audit_recall"] >= 0.9).all() and (found["kept"] == (found["component_id"] == found.index)).all()


def test_graph_search_finds_what_it_is_asked(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[:200] = x[0] + 0.1 * rng.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = vamana.build_graph(x)
    assert (near < len(x)).all() and (near != np.arange(len(x))[:, None]).all() and ((near >= 0).sum(axis=1) <= 24).all()
    has = near >= 0
    best, (a, b) = vamana.search_graph(x, np.concatenate([[0], np.cumsum(has.sum(axis=1))]), near[has], x, 7, 16, 0.93)
    assert (best[:, 0] == (x @ x.T).argmax(axis=1)).mean() > 0.9
    true = x @ x.T >= 0.93
    found = np.zeros(true.shape, dtype=bool)
    found[a, b] = True
    assert (found & true).sum() >= 0.9 * true.sum() and len(a) == found.sum()
    for n in (0, 1, 2, 13, 30):
        small = vamana.build_graph(x[300 : 300 + n])
        assert small.shape == (n, 24) and (small < max(n, 1)).all()


def test_embedding_rows_that_repeat_an_id(spark):
    a, b = np.eye(16)[0], np.eye(16)[1]
    rows = [(1, a, 0), (1, b, 0), (2, a + 0.01, 0), (3, b + 0.01, 0), (4, b + 0.02, 0), (9, a, 1), (None, a + 0.02, 0)]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    found = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()))
    assert found == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (9, 0, 9)]


def pages():
    big, other = "<p>" + "é text " * 300, "<p>" + "y" * 1000
    return [(1, "http://a/é?x=1", big, 0), (2, "http://a/2", big, 0), (9, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (6, "u", "", 0), (7, "u", other, 0), (8, "u\r\nX: y", other + "z", 0), (None, "u", big, 0), (9, "u", big, 0)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, digest int")
    found = warc.round_trip(df, records_per_file=3)
    rows = df.where("page_id is not null").dropDuplicates(["page_id"]).toPandas()
    wanted = sorted(map(str, duckdb.sql(warc.OP6_SQL.replace("FROM pages", "FROM rows")).fetchall()))
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(got) == len(pages())
    assert sorted(map(str, {tuple(r) for r in got if r["page_id"] is not None})) == wanted and len(rows)
    assert [r["refers_to"] for r in got if r["page_id"] is None] == [9]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_members_stand_alone(spark):
    import gzip

    df = spark.createDataFrame(pages(), "page_id long, url string, html string, digest int").where("page_id is not null")
    raw, normal = fresh_path(spark, "t-raw"), fresh_path(spark, "t-normal")
    mono = warc.write_archives(warc.assign_types(df), raw, records_per_file=4)
    done = warc.normalise(mono, raw, normal)
    index = warc.read_index(done, normal).collect()
    assert len(index) == df.count()
    for r in index:
        with open(normal.removeprefix("file://") + "/" + r["path"], "rb") as f:
            f.seek(r["offset"])
            member = gzip.decompress(f.read(r["length"]))
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and member.count(b"WARC-Record-ID") == 1
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(warc.read_index(done, normal), normal).collect()}
    assert payloads[3] == b"small" and payloads[5] == b"" and payloads[1] is None and payloads[9] == pages()[0][2].encode()


def test_every_query_is_registered():
    assert [int(k[2:].split("_")[0]) for k in registry.QUERIES] == list(range(1, 14))


def test_pipeline_stages_against_brute_force(spark, documents, nothing, tmp_path):
    import re
    from collections import Counter

    import corpus_pipeline
    from plumbline.llm import mixing, packing, quality
    from tokenizers import Tokenizer
    import public_tokenizers

    from test_text_operators import brute_components

    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    blank = r"[\x20\x09-\x0D]"
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda df: Counter(map(tuple, df.collect()))

    def run(name):
        found = stages[name](spark, docs, str(tmp_path))
        assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
        assert stages[name](spark, nothing, str(tmp_path)).count() == 0
        found.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    # quality: the k greatest keys of all rows, ties included
    _, scores, least = quality.resample(docs, labels)
    keyed = sorted((r["gumbel_key"] for r in scores.collect()), reverse=True)
    kept = run("quality classifier")
    assert kept.count() == sum(x >= least for x in keyed) and not rows(kept) - rows(docs)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores.collect() if r["gumbel_key"] >= least}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))  # what follows sees every odd row
    # exact dedup: of equal texts the longest, then the smallest id; one of repeated rows
    best = {}
    for r in docs.collect():
        key = re.sub(blank, "", r["text"] or "")
        rank = (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        best[key] = min(best.get(key, rank), rank)
    docs = run("exact dedup")
    assert Counter(best.values()) == Counter((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
    # near copies: the first of each group; rows without an id stay
    label, _ = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    wanted = Counter({r: n for r, n in rows(docs).items() if r[0] is None or label[r[0]] == r[0]})
    docs = run("n-gram Jaccard join")
    assert rows(docs) == wanted
    # the mix: every row as often as SQL says
    documents = docs.toArrow()  # noqa: F841  read by name
    taken = Counter()
    for doc, size, _, _, n in duckdb.sql(mixing.OP3_SQL).fetchall():
        taken[doc, size] += n // size if size else 0
    sizes = lambda df: Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in df.collect())
    docs = run("mixing")
    assert {k: n for k, n in sizes(docs).items() if k[1]} == {k: n for k, n in taken.items() if n}
    # packing: each document's ids, in gapless sequences
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r["doc_id"]] += len(exact.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    found = Counter()
    for r in pieces:
        found[r["doc_id"]] += r["length"]
    assert found == tokens
    at = 0
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * packing.SEQUENCE + r["offset"] == at
        at += r["length"]
    assert stages["packing"](spark, nothing, str(tmp_path)).count() == 0
