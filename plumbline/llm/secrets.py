"""Secret scans: fixed patterns and a token-efficiency test.

Patterns find assignments, access key ids and long hexadecimal strings. The
token-efficiency test looks at every run of key characters of ``min_length`` or
more: a byte-level BPE vocabulary needs few tokens for language and many for
random strings, so a run with at most ``max_ratio`` characters per token is
reported, unless it is a known digest (hexadecimal of a digest's length, a UUID)
or made of identifiers (numbers, and words, humps or dotted names with a short
number at the end). A run that does not pass as a whole is judged by its parts, so
that words around a random string do not hide it: stretches of parts between
separators that are no words pass by the same length and ratio. There, and in runs
of identifiers, a part is a word by its letter case and a better ratio.

A vectorised pass over the bytes finds the runs; only those, and texts with one
of the assignment words, are looked at again. Whole texts are read.

Nulls and edges: a null or empty text has no spans; overlapping spans of
different pattern kinds are all reported; a random string that overlaps a pattern
span is not reported twice; repeated rows are scanned each. Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import load_encoder, public_vocabulary
from .shared import table
from .wordhash import text_chunks

KINDS = ("assign", "access", "hex", "random")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
MIN_RUN = 16
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})$")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
#: Digits; or one letter, then humps and capitals of two letters or more, then up to four digits. Atomic, so that a long run costs one pass.
IDENTIFIER = re.compile(r"(?>\d+\Z|[A-Z]\d{0,4}\Z|(?:[a-z](?![a-z]))?+(?>[A-Z]++[a-z]{2,}+|[a-z]{2,}+|[A-Z]{2,}+)*+\d{0,4}\Z)")
PART = re.compile(r"[^+/_.=-]+")
KNOWN = re.compile(rf"(?<![0-9A-Za-z])(?:{DIGEST.pattern[:-1]}|{UUID.pattern[:-1]})(?![0-9A-Za-z])")
SPANS = "array<struct<kind:string,start:long,end:long>>"


def _is_known(run: str) -> bool:
    return bool(DIGEST.match(run) or UUID.match(run) or all(IDENTIFIER.match(part) for part in re.split(r"[+/_.=-]+", run)))


def _random_spans(run: str, encode, min_length: int, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what the token-efficiency test finds in a run."""
    poor = lambda text: len(text) >= min_length and len(text) <= max_ratio * len(encode(text))
    if len(run) < min_length:
        return []
    if not _is_known(run) and poor(run):
        return [(0, len(run))]
    spans: list[tuple[int, int]] = []
    held: list[tuple[int, int, bool]] = []  # start, end and whether it may end a stretch

    def close() -> None:
        while held and not held[0][2]:
            held.pop(0)
        while held and not held[-1][2]:
            held.pop()
        if held:
            if poor(run[held[0][0] : held[-1][1]]):
                spans.append((held[0][0], held[-1][1]))
            else:
                spans.extend((a, b) for a, b, _ in held if poor(run[a:b]))
        held.clear()

    at = 0
    for known in [*KNOWN.finditer(run), None]:
        for m in PART.finditer(run, at, known.start() if known else len(run)):
            part = m[0]
            named = bool(IDENTIFIER.match(part))
            if named and (part.isdigit() or len(part) > max_ratio * len(encode(part))):
                close()
            else:
                held.append((m.start(), m.end(), not named or len(part) >= min_length))
        close()
        at = known.end() if known else at
    return spans


def _runs(raw: np.ndarray, bounds: np.ndarray, least: int):
    """(row, text, first code point) of each run of key characters."""
    is_key = np.zeros(256, dtype=bool)
    is_key[list(RUN)] = True
    inside = is_key[raw]
    breaks = np.zeros(len(raw) + 1, dtype=bool)
    breaks[bounds] = True
    change = np.ones(len(raw) + 1, dtype=bool)
    change[1:-1] = (inside[1:] != inside[:-1]) | breaks[1:-1]
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = (ends - starts >= least) & inside[starts] if len(raw) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    rows = np.searchsorted(bounds, starts, side="right") - 1
    for row, start, end, first in zip(rows.tolist(), starts.tolist(), ends.tolist(), (points[starts] - points[bounds[rows]]).tolist(), strict=True):
        yield row, raw[start:end].tobytes().decode("ascii"), first


def _scanner(vocabulary: str, pattern: str, min_length: int, max_ratio: float):
    def scan(batches):
        encode, _ = load_encoder(vocabulary, pattern)
        for batch in batches:
            texts = batch.column("text")
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
            for first_row, raw, bounds in text_chunks(texts):
                likely: list[tuple[int, str, int]] = []
                for row, run, first in _runs(raw, bounds, min(MIN_RUN, min_length)):
                    spans = found[first_row + row]
                    spans += [(first + m.start(), 1, first + m.end()) for m in ACCESS.finditer(run)]
                    spans += [(first + m.start(), 2, first + m.end()) for m in HEX.finditer(run)]
                    likely += [(first_row + row, first + a, first + b) for a, b in _random_spans(run, encode, min_length, max_ratio)]
                low = raw.tobytes().lower()
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if any(low.find(word, a, b) >= 0 for word in map(str.encode, ASSIGN_WORDS)):
                        text = raw[a:b].tobytes().decode()
                        found[first_row + i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
                for row, first, last in likely:
                    if all(end <= first or start >= last for start, kind, end in found[row] if kind != 3):
                        found[row].append((first, 3, last))
            rows = [[{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in sorted(spans)] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    return scan


def scan_secrets(documents: DataFrame, vocabulary: str, pattern: str, min_length: int = 20, max_ratio: float = 2.0) -> DataFrame:
    """doc_id, spans (kind, start, end in code points; by start, then kind)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner(vocabulary, pattern, min_length, max_ratio), f"doc_id long, spans {SPANS}")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), *public_vocabulary())
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
