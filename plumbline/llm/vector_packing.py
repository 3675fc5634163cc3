"""Vector best-fit packing of tokenised documents into sequences.

A sequence is a bin with three capacities: tokens, documents and attention cost
(the sum of squared piece lengths). A piece of n tokens asks for (n, 1, n * n).
Pieces are placed from the longest down, each into the open sequence that leaves the
smallest weighted residual norm, or that has the largest weighted dot product of
request and residual, among those that hold it under every capacity; a sequence is
opened only where no open one holds the piece.

Requests follow from the length alone, so pieces of equal length are alike and so are
sequences filled alike. The rule therefore runs over the counts of lengths, at most
one a token of the sequence length however many documents there are, and places a
whole run of equal pieces into a whole range of equal sequences at once. What comes
out is a short list of placements (length, ranks, sequences); each task then finds
the sequence and offset of its pieces from their rank among the pieces of their
length. The packing is that of one best-fit over all pieces and does not depend on
partitions. Ranks come from a count by task and length and a running sum over
those counts.

Token ids are those of the tokenizer file. White space never lies within a token of
its pattern, so words between white space are encoded one by one: each distinct word
of some megabytes of text once, most of them from a bounded cache, and Arrow deals
their ids out to the texts. Words with characters beyond the Latin blocks, control
characters or the marks of added tokens go through the tokenizer itself.

Nulls and edges: a null or empty text is the end token alone; a null doc_id and repeated
rows are packed like others; a document longer than a sequence is cut into full pieces
and a last one; an empty table gives no pieces; ties go to the sequence opened first.
Columns besides doc_id and text are ignored. A capacity that cannot hold some piece
alone raises ValueError.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, table

SEQUENCE = 2048
END = 0
PORTION = 8 << 20  # bytes of text whose words are looked up together; affects cost only
PIECES = "doc_id long, piece int, start long, length long, sequence_id long, offset long, ids binary"
# fixed values: the pre-token pattern of word_bpe_49k.json
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Letters that every version of Unicode reads alike and that are their own composed form.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-įı-ɏ]*")  # without İ, whose small form is two characters


class WordIds(dict):
    """Token ids, as bytes of 16-bit numbers, of what stands between white space; the first ``limit`` plain words that are met stay."""

    def __init__(self, tokenizer: str, limit: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.limit = Tokenizer.from_file(tokenizer), limit
        self.tokenize, self.letters = self.tokenizer.model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def part_ids(self, part: str) -> bytes:
        """The ids of one pre-token in lower case."""
        return array("H", [t.id for t in self.tokenize(part if part.isascii() else self.letters(part)[0][0])]).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii()
        if plain and word.isalpha():
            small = word.lower()
            if small != word:
                return self[small]
            found = self.part_ids(word)
        elif plain and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        elif not PLAIN.fullmatch(word) or "<|" in word:
            return array("H", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif word.isalpha():
            found = self.part_ids(word.lower())
        elif word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        else:
            found = b"".join([self[x] if x.isalpha() else self.part_ids(x) for x in PRETOKEN.findall(word.lower())])
        if len(self) < self.limit and len(word) <= 32:
            self[word] = found
        return found

    def texts_ids(self, texts: pa.Array) -> pa.Array:
        """The ids of each text; a word is looked up once however often the texts have it."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        ids = pa.array([self[word] for word in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], pa.large_binary())
        return pc.binary_join(pa.ListArray.from_arrays(words.offsets, ids.take(coded.indices)), pa.scalar(b"", pa.large_binary()))

    def text_ids(self, text: str) -> bytes:
        return self.texts_ids(pa.array([text], pa.string()))[0].as_py()


def _portions(texts: pa.Array, size: int):
    """Ranges of consecutive texts of about ``size`` bytes, and of one text at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        after = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield at, after - at
        at = after


_known: dict[tuple[str, int], WordIds] = {}


def _tokenised(tokenizer: str, end: int, sequence: int, words_in_memory: int):
    names = ["doc_id", "piece", "start", "length", "part", "place", "ids"]

    def run(batches):
        if (tokenizer, words_in_memory) not in _known:  # a worker keeps it for its next task
            _known[tokenizer, words_in_memory] = WordIds(tokenizer, words_in_memory)
        words, closing = _known[tokenizer, words_in_memory], array("H", [end]).tobytes()
        part, met = TaskContext.get().partitionId(), [0] * (sequence + 1)
        for batch in batches:
            texts = batch.column("text")
            for row, n in _portions(texts, PORTION):
                out = ([], [], [], [], [], [], [])
                for doc_id, ids in zip(batch.column("doc_id").slice(row, n).to_pylist(), words.texts_ids(texts.slice(row, n)), strict=True):
                    ids = ids.as_py() + closing
                    for piece, at in enumerate(range(0, len(ids), 2 * sequence)):
                        own = ids[at : at + 2 * sequence]
                        n = len(own) // 2
                        for column, value in zip(out, (doc_id, piece, at // 2, n, part, met[n], own), strict=True):
                            column.append(value)
                        met[n] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def best_fit(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm") -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Placements by length, and the number of sequences.

    A placement is (first rank, first sequence, pieces a sequence, offset): the pieces of
    its length from that rank on, up to the next placement's, fill one sequence after the
    other. ``weights`` are those of tokens, documents and attention, each a share of its
    capacity. Under the norm a sequence that took a piece has a smaller residual than
    before and takes the next one too, as many as fit; under the dot product it takes
    one, as its like have more left then.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    room = np.zeros((0, 3), dtype=np.int64)  # what is left in each sequence of a range of equal ones
    ranges = np.zeros((0, 2), dtype=np.int64)
    scale, weight = np.asarray(capacity, dtype=float), np.asarray(weights)
    placements: dict[int, list[tuple[int, int, int, int]]] = {}
    opened = 0
    for length in sorted(counts, reverse=True):
        need, left, rank = np.array([length, 1, length * length]), counts[length], 0
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity {capacity}")
        alive = room[:, 0] > 0
        room, ranges = room[alive], ranges[alive]
        while left:
            holds = np.flatnonzero((room >= need).all(axis=1))
            if not len(holds):
                each = int((np.asarray(capacity) // need).min()) if rule == "norm" else 1
                more = -(-left // each)
                room, ranges = np.vstack([room, [capacity]]), np.vstack([ranges, [(opened, opened + more)]])
                opened += more
                chosen = len(room) - 1
            else:
                past = room[holds] - need
                cost = (weight * (past / scale) ** 2).sum(axis=1) if rule == "norm" else -(weight * (room[holds] / scale) * (need / scale)).sum(axis=1)
                alike = holds[cost == cost.min()]
                chosen = alike[ranges[alike, 0].argmin()]
            each = int((room[chosen] // need).min()) if rule == "norm" else 1
            before, (low, high) = room[chosen].copy(), ranges[chosen]
            full = min(int(high - low), left // each)
            offset = int(capacity[0] - before[0])
            cut = []  # (room, range) that replace the chosen range
            if full:
                placements.setdefault(length, []).append((rank, int(low), each, offset))
                rank, left, low = rank + full * each, left - full * each, low + full
                cut.append((before - each * need, (low - full, low)))
            if left and low < high:  # fewer pieces than one more sequence takes
                placements.setdefault(length, []).append((rank, int(low), left, offset))
                cut.append((before - left * need, (low, low + 1)))
                rank, left, low = rank + left, 0, low + 1
            if low < high:
                cut.append((before, (low, high)))
            room[chosen], ranges[chosen] = cut[0]
            if cut[1:]:
                room, ranges = np.vstack([room, [r for r, _ in cut[1:]]]), np.vstack([ranges, [r for _, r in cut[1:]]])
    return placements, opened


def _placed(placements: dict[int, list[tuple[int, int, int, int]]]):
    names = ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
    tables = {n: np.array(rows, dtype=np.int64).T for n, rows in placements.items()}

    def run(batches):
        for whole in batches:
            for row in range(0, whole.num_rows, 2000):
                batch = whole.slice(row, 2000)
                length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
                sequence, offset = np.empty_like(rank), np.empty_like(rank)
                for n in np.unique(length):
                    own = length == n
                    first, low, each, at = tables[int(n)]
                    k = np.searchsorted(first, rank[own], side="right") - 1
                    past = rank[own] - first[k]
                    sequence[own], offset[own] = low[k] + past // each[k], at[k] + past % each[k] * n
                ids = [np.frombuffer(x.as_buffer(), dtype="<u2").astype("<u4").tobytes() for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(sequence), pa.array(offset), pa.array(ids, pa.binary())], names)

    return run


def pack(documents: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end: int = END, most_documents: int | None = None, most_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", words_in_memory: int = 400_000) -> DataFrame:
    """Pieces: doc_id, piece, start, length, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Without limits a sequence may hold as many documents as tokens, and the attention
    cost of one full piece: no more than tokens allow anyway.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialise(texts.mapInArrow(_tokenised(tokenizer, end, sequence, words_in_memory), "doc_id long, piece int, start long, length long, part long, place long, ids binary"), "fit-ids")
    counts = tokens.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = materialise(counts.withColumn("base", before), "fit-counts")
    of_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``sequence`` rows
    placements, _ = best_fit(of_length, (sequence, most_documents or sequence, most_attention or sequence**2), weights, rule)
    ranked = tokens.join(counts.select(F.col("length").alias("_length"), F.col("part").alias("_part"), "base"), (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part")))
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("base") + F.col("place")).alias("rank"), "ids")
    return ranked.mapInArrow(_placed(placements), PIECES)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_vector_packing(spark, sf_dir: str) -> DataFrame:
    """One row a piece of documents; tokens alone bind, as any further limit would need more sequences."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizer())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
