"""Mixture-controlled packing of tokenised documents into fixed windows.

Deficit round-robin over one queue per source: in each window a queue gets a
quantum of tokens in proportion to what it holds of the whole corpus, serves
documents from its head, cuts the last one where the quantum ends, and carries
the fraction that it was not served (its deficit) into the next window. As the
quantum never changes, what queue q has been served before window w is
floor(w * window * total_q / total): every task can tell the place of its
documents from the totals and from how many tokens precede them in their queue,
and so deficits carry across windows and partitions without a serial pass.
Windows follow each other without gaps and are cut into sequences, so that only
the very last sequence is padded.

Steps: tokenise each text once and write the ids (with the place in the task's
own part of each queue); add up tokens per task and queue; a running sum over
those few rows gives each part its place in the queue; then cut.

Queues are the sources, however many (null is one of them). The totals of at most
``max_queues`` go to every task; those of more are joined, and the places of the
blocks that queues have in windows are sums over tables. Both ways give the same
pieces. The order in a queue is the order of the written parts. A window holds
``window_sequences`` sequences.

Text that spells an added token of the tokenizer (``<|endoftext|>``) has that
token's id, as the tokenizer's own default is.

Nulls and edges: a null or empty text is the end token alone; a null source is a
source; repeated rows are packed each; a text longer than a sequence or a window
is cut; an empty table gives no pieces. Columns besides doc_id, text, source are
ignored.
"""

from __future__ import annotations

import base64
import json
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, table

SEQUENCE = 2048
END = 1


class PieceIds(dict):
    """Token ids, as bytes, of ' ' + piece; the first ``limit`` pieces that are met stay in memory."""

    def __init__(self, encode, code: str, limit: int):
        self.encode, self.code, self.limit = encode, code, limit

    def ids(self, text: str) -> bytes:
        return array(self.code, self.encode(text)).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise ValueError("no token border here")
        found = self.ids(" " + piece)
        if len(self) < self.limit and len(piece) <= 32 and "\n" not in piece:
            self[piece] = found
        return found

    def text_ids(self, text: str) -> bytes:
        """The ids of a whole text.

        A single space between two other characters always begins a token of the
        vocabulary's pattern; a text with other kinds of space is encoded at once.
        """
        head, *rest = text.split(" ")
        if not rest or not head or head[-1].isspace():
            return self.ids(text)
        try:
            return self.ids(head) + b"".join([self[x] for x in rest])
        except ValueError:
            return self.ids(text)


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Text and id of the added tokens in the tokenizer file beside a ranks file."""
    file = Path(vocabulary).with_suffix(".json")
    found = json.loads(file.read_text(encoding="utf-8"))["added_tokens"] if file.exists() else []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in found):
        raise ValueError("only added tokens that are matched as they stand")
    return {t["content"]: t["id"] for t in found}


def load_encoding(vocabulary: str, pattern: str, added: dict[str, int] | None = None):
    """The byte-level BPE of a ranks file with its added tokens, and the largest id."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return encoding, max([*ranks.values(), *(added or {}).values()])


def load_encoder(vocabulary: str, pattern: str):
    """The ids of a text that holds no added token, and the largest id."""
    encoding, largest = load_encoding(vocabulary, pattern)
    return encoding.encode_ordinary, largest


def _tokenised(vocabulary: str, pattern: str, end: int, pieces_in_memory: int):
    def run(batches):
        added = added_tokens(vocabulary)
        encoding, largest = load_encoding(vocabulary, pattern, added)  # one for both uses: it takes much of a worker's memory
        encode, encode_marked = encoding.encode_ordinary, lambda text: encoding.encode(text, allowed_special="all")
        code = "H" if max(largest, end) < 1 << 16 else "I"
        cache, closing, width = PieceIds(encode, code, pieces_in_memory), array(code, [end]).tobytes(), array(code).itemsize
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            for row in range(0, len(texts), 1000):
                queues = batch.column("queue").slice(row, 1000)
                ids = [(array(code, encode_marked(text)).tobytes() if text and any(x in text for x in added) else cache.text_ids(text or "")) + closing for text in texts.slice(row, 1000).to_pylist()]
                counts = [len(x) // width for x in ids]
                before, place = {}, []
                for queue, n in zip(queues.to_pylist(), counts, strict=True):
                    place.append(before.get(queue, 0))
                    before[queue] = place[-1] + n
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, 1000), queues, pa.array([part] * len(ids), pa.int64()), pa.array(place, pa.int64()), pa.array(counts, pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "queue", "part", "place", "doc_tokens", "width", "ids"])
                part += 1

    return run


class Layout:
    """Places of queue tokens in the packed stream, from the totals of all queues."""

    def __init__(self, totals: dict[str | None, int], window: int):
        self.order, self.totals = {q: i for i, q in enumerate(totals)}, list(totals.values())
        self.total, self.window, self.known = sum(self.totals), window, {}

    def served(self, w: int) -> list[int]:
        return [min(t, w * self.window * t // self.total) for t in self.totals]

    def at(self, w: int) -> tuple[list[int], list[int], list[int]]:
        """Of window w: tokens served before and after by queue, and the place of each queue's block."""
        if w not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            before, after = self.served(w), self.served(w + 1)
            blocks = np.cumsum([sum(before), *(b - a for a, b in zip(before, after, strict=True))]).tolist()
            self.known[w] = before, after, blocks
        return self.known[w]

    def pieces(self, queue, first: int, n: int, sequence: int):
        """(start in the document, length, place in the stream) of n tokens that follow the first ones of a queue."""
        q = self.order[queue]
        at, end = first, first + n
        while at < end:
            w = ((at + 1) * self.total - 1) // (self.window * self.totals[q])
            before, after, blocks = self.at(w)
            upto = min(end, after[q])
            place = blocks[q] + at - before[q]
            while at < upto:
                k = min(upto - at, sequence - place % sequence)
                yield at - first, k, place
                at, place = at + k, place + k


def _cut(totals: dict, window: int, sequence: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        layout = Layout(totals, window)
        for whole in batches:
            for row in range(0, whole.num_rows, 1000):
                batch = whole.slice(row, 1000)
                rows = {c: batch.column(c).to_pylist() for c in ("doc_id", "queue", "first", "doc_tokens", "width")}
                out = ([], [], [], [], [], [], [])
                for doc_id, queue, first, n, width, ids in zip(*rows.values(), batch.column("ids"), strict=True):
                    ids = np.frombuffer(ids.as_buffer(), dtype="<u2" if width == 2 else "<u4").astype("<u4")
                    for start, k, place in layout.pieces(queue, first, n, sequence):
                        for column, value in zip(out, (doc_id, start, k, n, place // sequence, place % sequence, ids[start : start + k].tobytes()), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:-1]] + [pa.array(out[-1], pa.binary())], names)

    return run


def _blocks(total: int, window: int):
    """Per queue: the windows that serve it, tokens served before and in each."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            for queue, n in zip(batch.column("queue").to_pylist(), batch.column("n").to_pylist(), strict=True):
                at = 0
                while at < n:
                    w = ((at + 1) * total - 1) // (window * n)
                    after = min(n, (w + 1) * window * n // total)
                    for column, value in zip(out, (queue, w, at, after - at), strict=True):
                        column.append(value)
                    at = after
                    if len(out[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["queue", "w", "before", "n"])
                        out = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["queue", "w", "before", "n"])

    return run


def _by_window(total: int, window: int):
    """Documents cut where windows end."""
    names = ["doc_id", "queue", "w", "first", "start", "doc_tokens", "ids"]

    def run(batches):
        for whole in batches:
            for row in range(0, whole.num_rows, 1000):
                batch = whole.slice(row, 1000)
                out = ([], [], [], [], [], [], [])
                for doc_id, queue, of, first, n, width, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "queue_tokens", "first", "doc_tokens", "width", "ids")), strict=True):
                    at = first
                    while at < first + n:
                        w = ((at + 1) * total - 1) // (window * of)
                        upto = min(first + n, of, (w + 1) * window * of // total)
                        part = np.frombuffer(ids, dtype="<u2" if width == 2 else "<u4")[at - first : upto - first].astype("<u4").tobytes()
                        for column, value in zip(out, (doc_id, queue, w, at, at - first, n, part), strict=True):
                            column.append(value)
                        at = upto
                kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def _by_sequence(sequence: int):
    """Pieces of one window cut where sequences end."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            for doc_id, start, n, place, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "place", "ids")), strict=True):
                at = 0
                while at < len(ids) // 4:
                    k = min(len(ids) // 4 - at, sequence - (place + at) % sequence)
                    for column, value in zip(out, (doc_id, start + at, k, n, (place + at) // sequence, (place + at) % sequence, ids[4 * at : 4 * (at + k)]), strict=True):
                        column.append(value)
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:-1]] + [pa.array(out[-1], pa.binary())], names)

    return run


def _cut_by_joins(placed: DataFrame, totals: DataFrame, window: int, sequence: int) -> DataFrame:
    """What _cut does, with the totals of any number of queues in a table (queue, n)."""
    total = totals.agg(F.sum("n")).first()[0]
    blocks = materialise(totals.mapInArrow(_blocks(total, window), "queue string, w long, before long, n long"), "packing-blocks")
    sums = blocks.groupBy(F.col("w").alias("_w")).agg(F.sum("n").alias("sum"))  # one row a window
    sums = sums.select("_w", (F.sum("sum").over(Window.orderBy("_w")) - F.col("sum")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("w").orderBy(F.col("queue").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")  # at most a window's tokens
    blocks = blocks.withColumn("within", within).join(sums, F.col("w") == F.col("_w")).select(F.col("queue").alias("q"), F.col("w").alias("at_w"), (F.col("base") + F.col("within") - F.col("before")).alias("shift"))
    cut = placed.join(totals.select(F.col("queue").alias("q"), F.col("n").alias("queue_tokens")), F.col("queue").eqNullSafe(F.col("q"))).drop("q")
    cut = cut.mapInArrow(_by_window(total, window), "doc_id long, queue string, w long, first long, start long, doc_tokens long, ids binary")
    cut = cut.join(blocks, F.col("queue").eqNullSafe(F.col("q")) & (F.col("w") == F.col("at_w"))).withColumn("place", F.col("shift") + F.col("first"))
    return cut.select("doc_id", "start", "doc_tokens", "place", "ids").mapInArrow(_by_sequence(sequence), PIECES)


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(documents: DataFrame, vocabulary: str, pattern: str, sequence: int = SEQUENCE, end: int = END, window_sequences: int = 64, max_queues: int = 1024, pieces_in_memory: int = 150_000) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    queue = F.col("source").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), F.col("text").cast("string").alias("text"))
    tokens = materialise(texts.mapInArrow(_tokenised(vocabulary, pattern, end, pieces_in_memory), "doc_id long, queue string, part long, place long, doc_tokens long, width int, ids binary"), "packing-ids")
    parts = tokens.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    parts = materialise(parts.withColumn("base", F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))), "packing-parts")
    sums = parts.groupBy("queue").agg(F.sum("n").alias("n"))
    totals = {r["queue"]: r["n"] for r in sums.limit(max_queues + 1).collect()}
    placed = tokens.join(parts.select(F.col("queue").alias("q"), F.col("part").alias("p"), F.coalesce("base", F.lit(0)).alias("base")), F.col("queue").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")))
    placed = placed.select("doc_id", "queue", (F.col("base") + F.col("place")).alias("first"), "doc_tokens", "width", "ids")
    if len(totals) > max_queues:
        return _cut_by_joins(placed, materialise(sums, "packing-totals"), window_sequences * sequence, sequence)
    totals = dict(sorted(totals.items(), key=lambda x: (x[0] is None, x[0] or "")))
    return placed.mapInArrow(_cut(totals, window_sequences * sequence, sequence), PIECES)


def public_vocabulary() -> tuple[str, str]:
    """The ranks of byte_bpe_50k.json and their pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents"), *public_vocabulary()))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
