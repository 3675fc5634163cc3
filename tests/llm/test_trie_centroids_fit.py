"""The prefix trie, centroid clustering and vector packing against plain Python."""

import hashlib
import math
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import prefix_trie, ptolemaic, vector_packing

TURNS = "conv_id long, turn long, role string, text string, cid string, path string, e int"


def conversations():
    """Shared heads, equal conversations, nulls, equal turns, repeated rows, families without a first member, long and branching ones."""
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), 62, 63, 104, 255, 256, 257, 1000]:
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"{rng.choice('ab')}{'é' * (t % 3)}") for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(3)]  # many equal ones
    rows += [(c, t, "user", "x" if t < c - 700 else f"y{c}") for c in range(700, 730) for t in range(c - 700 + 9)]  # one more branch at each depth
    rows += [(900, t, None if t % 2 else "user", "long" if t % 5 else None) for t in range(300)]
    rows += [(41, None, "user", "null turn"), (41, 1, "user", "b"), (41, 1, "user", "a"), (41, 1, "user", "a"), (42, 0, None, None), (43, 0, "", ""), (-7, 0, "user", "negative"), (None, 0, "user", "nobody's"), (3, 1, "user", "repeated"), (3, 1, "user", "repeated")]
    rng.shuffle(rows)
    return [(*r, "c", "p", 1) for r in rows]


def plain_trie(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), sha(sha(role or "") + (text or "")), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = leaves.get(k) or 1
        saved[k] = saved.get(k, 0) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
            leaves[k[:-1]] = leaves.get(k[:-1], 0) + leaves[k]
            saved[k[:-1]] = saved.get(k[:-1], 0) + saved[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))) for k, m in members.items()}
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


def ordered(rows):
    return sorted(tuple(r) for r in rows)


def test_trie_agrees_with_plain_python(spark):
    rows = conversations()
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3)).collect()
    assert sorted(map(tuple, found), key=lambda r: (r[0], r[1])) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1]))


def test_trie_without_rows_or_turns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a", "", "", 1)], TURNS)).collect() == []
    # 8 takes at most h turns of 5, which is absent, and has none of its own after them
    only = [(c, 0, "user", "a", "", "", 1) for c in (8,)]
    assert zlib.crc32(b"8") % 9 > 0
    assert [tuple(r)[:6] for r in prefix_trie.prefix_trie(spark.createDataFrame(only, TURNS)).collect()] == [(8, 0, None, 1, 0, 1)]


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 70)]
    found = spark.createDataFrame(pairs, "a int, b int").selectExpr("a", "b", f"{prefix_trie.two_fattest('a', 'b')} AS f").collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x) for r in found)


def test_fat_binary_search_finds_the_exit_node(spark):
    """Of conversations that are in no batch yet: the deepest shared extent and the edge below it."""
    rng = random.Random(8)
    strings = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(60)})
    rows = [(i * 5, t, "u", x) for i, s in enumerate(strings) for t, x in enumerate(s)]  # first of their families: nothing is lent
    upto = prefix_trie.prefixes(prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    paths = {r["conv_id"]: r["path"] for r in upto.groupBy("conv_id").agg(prefix_trie.F.array_sort(prefix_trie.F.collect_list(prefix_trie.F.struct("d", "h", "g", "upto"))).alias("path")).collect()}
    schema = "cid long, path array<struct<h: long, g: long, upto: long>>"
    given = [(c, [(x["h"], x["g"], x["upto"]) for x in p]) for c, p in paths.items()]
    inside, outside = given[::2], given[1::2]
    nodes = prefix_trie.compacted(spark.createDataFrame(inside, schema), 14)
    known = [strings[c // 5] for c, _ in inside]
    extents = {""} | {s[:d] for s in known for d in range(1, len(s) + 1) if s[:d] in known or len({x[d : d + 1] for x in known if x.startswith(s[:d])}) > 1}
    assert {(r["e"], r["p"]) for r in nodes.select("e", "p").collect()} == {(len(x), max(len(y) for y in extents if x.startswith(y) and y != x)) for x in extents if x}
    assert nodes.count() == len(extents) - 1
    found = prefix_trie.exits(spark.createDataFrame([(c, 0, p) for c, p in outside], "cid long, a int, path array<struct<h: long, g: long, upto: long>>"), nodes, 14).collect()
    assert len(found) == len(outside)
    for r in found:
        s = strings[r["cid"] // 5]
        shared = max(len(x) for x in extents if s.startswith(x))
        child = [x for x in extents if len(x) > shared and x.startswith(s[: shared + 1]) and len(s) > shared]
        assert r["xp"] == (shared if child else None)
        assert r["xe"] == (min(map(len, child)) if child else None)


def plain_lloyd(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(near(x)[1], []).append(x)
        at = [[sum(v) // len(own[j]) for v in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(at)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    sums = {j: sum(d for _, c, d in found if c == j) for j in range(len(at))}
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, j, d in found]


def vectors(dims=6):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(3 * (i % 5), 0.4) for _ in range(dims)]) for i in range(300)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(40)]  # copies
    rows += [(2000, None), (2001, []), (2002, [1.0] * (dims - 1)), (2003, [None] * dims), (2004, [math.nan] * dims), (2005, [math.inf] * dims), (2006, [0.0] * dims), (2007, [-1.0] * dims), (None, [1.0] * dims), (5, rows[6][1])]
    return rows


@pytest.mark.parametrize(("rows", "clusters"), [(vectors(), 8), (vectors(), 3), (vectors()[:2], 8), ([(1, [0.0] * 6), (2, [0.0] * 6), (3, [1e30] * 6), (4, [5.0] * 6)], 3), ([(i, [i % 2 * 2.0 - 1] * 6) for i in range(20)], 4)])
def test_centroids_agree_with_plain_python(spark, rows, clusters):
    frame = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, x int, near int").repartition(3)
    found = ptolemaic.summary(frame, clusters=clusters, rounds=6, dimensions=6).collect()
    fits = lambda v: v if v < 1 << 63 else None
    wanted = [(i, j, *map(fits, (d, s, t)), sha) for i, j, d, s, t, sha in plain_lloyd(rows, clusters, 6, 6, 1024, 3)]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_no_vectors_no_clusters(spark):
    for rows in ([], [(1, None)]):
        assert ptolemaic.summary(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_bounds_are_below_the_distances_and_save_some(spark):
    rng = np.random.default_rng(1)
    for scale in (3, 1000, 1 << 25):
        points = rng.integers(-scale, scale, (200, 8))
        pivots, centroids = points[:6].tolist(), points[3:9].tolist()
        pairs = [(i, j) for i in range(6) for j in range(i)]
        near = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1).astype(float)) for p in pivots], axis=1)
        bound = ptolemaic.Bounds(pivots, pairs, centroids).squares(near)
        true = np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        assert (bound <= true).all()
    frame = spark.createDataFrame([(i, x) for i, x in vectors() if x and len(x) == 6], "vec_id long, embedding array<double>")
    _, _, work = ptolemaic.cluster(frame, clusters=5, rounds=8, dimensions=6)
    assert all(w["computed"] < w["all"] / 2 for w in work[4:])


def ids_of(texts):
    from tokenizers import Tokenizer

    return [x.ids + [0] for x in Tokenizer.from_file(vector_packing.public_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(rows, pieces, sequence, most_documents, most_attention):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) <= sequence and len(own) <= most_documents and sum(p["length"] ** 2 for p in own) <= most_attention
    wanted = {}
    for (i, text), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
        wanted.setdefault(i, []).extend((at // sequence, at, tuple(ids[at : at + sequence])) for at in range(0, len(ids), sequence))
    assert {i: sorted((p["piece"], p["start"], tuple(np.frombuffer(p["ids"], dtype="<u4").tolist())) for p in own) for i, own in by_doc.items()} == {i: sorted(x) for i, x in wanted.items()}
    return len(by_sequence)


@pytest.mark.parametrize(("limits", "rule", "weights"), [((2048, None, None), "norm", (1.0, 0.0, 0.0)), ((64, 5, None), "norm", (1.0, 0.2, 0.2)), ((64, None, 2500), "dot", (1.0, 0.5, 0.5)), ((300, 4, 50_000), "dot", (1.0, 1.0, 1.0))])
def test_fit_keeps_every_capacity_and_token(spark, documents, limits, rule, weights):
    sequence, most_documents, most_attention = limits
    if most_attention and most_attention < sequence**2:
        with pytest.raises(ValueError, match="exceeds"):
            vector_packing.pack(documents, vector_packing.public_tokenizer(), *limits[:1], most_documents=1, most_attention=1, rule=rule)
        most_attention = sequence**2
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    pieces = vector_packing.pack(documents, vector_packing.public_tokenizer(), sequence, most_documents=most_documents, most_attention=most_attention, weights=weights, rule=rule).collect()
    used = check_pieces(rows, pieces, sequence, most_documents or sequence, most_attention or sequence**2)
    total = sum(len(p["ids"]) // 4 for p in pieces)
    least = max(-(-total // sequence), -(-len(pieces) // (most_documents or sequence)))
    assert used <= least * 1.15 + 1


def test_fit_of_nothing(spark, nothing):
    assert vector_packing.pack(nothing, vector_packing.public_tokenizer()).collect() == []


def plain_fit(lengths, capacity, weights):
    """Best fit by the weighted residual norm, piece by piece."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        fits = [(sum(w * ((r - x) / c) ** 2 for w, r, x, c in zip(weights, room, need, capacity, strict=True)), i) for i, room in enumerate(open_) if all(r >= x for r, x in zip(room, need, strict=True))]
        if fits:
            i = min(fits)[1]
        else:
            open_.append(list(capacity))
            i = len(open_) - 1
        open_[i] = [r - x for r, x in zip(open_[i], need, strict=True)]
    return sorted(map(tuple, open_))


@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), (1.0, 0.3, 0.1)])
def test_best_fit_over_counts_is_best_fit_over_pieces(weights):
    rng = random.Random(2)
    for _ in range(40):
        capacity = (100, rng.randint(2, 12), rng.choice([10_000, 5_000]))
        lengths = [rng.randint(1, min(70, math.isqrt(capacity[2]))) for _ in range(rng.randint(1, 150))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        placements, opened = vector_packing.best_fit(counts, capacity, weights)
        rooms = [list(capacity) for _ in range(opened)]
        for n, rows in placements.items():
            for (first, low, each, offset), after in zip(rows, [*[r[0] for r in rows[1:]], counts[n]], strict=True):
                for k in range(after - first):
                    room = rooms[low + k // each]
                    assert 100 - room[0] == offset + k % each * n
                    for x, v in enumerate((n, 1, n * n)):
                        room[x] -= v
        assert all(min(r) >= 0 for r in rooms)
        assert sorted(map(tuple, rooms)) == plain_fit(lengths, capacity, weights)


def test_word_ids_are_the_tokenizers():
    rng = random.Random(1)
    letters = [chr(i) for i in range(0x20, 0x250) if not 0x7F <= i < 0xA0] + list("\t\n\r '") * 20 + ["'s", "'LL", "<|", "<|endoftext|>", "|>", "https://a.b/c?d=1", "AKIA0"] + list("Σσςİé́中文ﬁ \x1c\x85\xa0😀̀ǅ٣K")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 50_000, " ", ""]
    words = vector_packing.WordIds(vector_packing.public_tokenizer(), 500)
    assert [np.frombuffer(words.text_ids(t), dtype="<u2").tolist() + [0] for t in texts] == ids_of(texts)
    assert len(words) <= 500


def test_word_ids_around_white_space_and_capitals():
    texts = ["a\vb\fc", "\x0b", "a\x1cb", "b\x1d", "x\r\ny\t\tz", "\u0301a \u0301b\n\u0301", "Alpha alpha, ALPHA. É é Éa, \xa0 a\xa0b", "a\x00", "\x7f ", "don't  DON'T", " lead", "trail \n", "a<", "<|", "<|endoftext|>", "w" * 40 + " W" + "w" * 39]
    words = vector_packing.WordIds(vector_packing.public_tokenizer(), 500)
    whole = words.texts_ids(pa.array([None, *texts, ""]).slice(1))  # of an array that begins further on
    assert [np.frombuffer(x, dtype="<u2").tolist() + [0] for x in whole.to_pylist()] == ids_of([*texts, ""])
    assert "Alpha" not in words and "alpha" in words


def test_portions_cover_every_text():
    for sizes in ([], [0], [5, 0, 3, 9, 1, 1, 1], [100], [0, 0, 100, 0]):
        texts = pa.array(["x" * n or None for n in sizes], pa.string())
        found = list(vector_packing._portions(texts, 6))
        assert [i for at, n in found for i in range(at, at + n)] == list(range(len(sizes)))
        assert all(n == 1 or sum(sizes[at : at + n]) <= 6 for at, n in found)


def test_a_word_is_tokenised_once_where_the_cache_is_full(monkeypatch):
    words, asked = vector_packing.WordIds(vector_packing.public_tokenizer(), 0), []
    tokenize = words.tokenize
    words.tokenize = lambda word: asked.append(word) or tokenize(word)
    monkeypatch.setitem(vector_packing._known, ("counted", 0), words)
    monkeypatch.setattr(vector_packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = ["alpha beta gamma"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    pieces = [p for b in vector_packing._tokenised("counted", 0, 2048, 0)([batch]) for p in b.to_pylist()]
    assert [np.frombuffer(p["ids"], dtype="<u2").tolist() for p in pieces] == ids_of(texts)
    assert sorted(asked) == ["alpha", "beta", "gamma"]
