"""WARC archives: writing, a normaliser for monolithic gzip, and reading by index.

The writer makes archives whose gzip stream runs over the whole file. The
normaliser inflates each such stream once, front to back in bounded buffers,
writes every record as a gzip member of its own, and writes a sidecar index with
the offset and length of each member. The reader takes members by that index.

Archives lie in the shared folder, one per ``records_per_file`` pages of a task,
under a name of their own for each attempt: the files of a lost attempt are never
listed in the manifest, and the manifest is a written table, so that no later
failure writes an archive anew.

Records: of equal payloads of at least ``min_revisit`` bytes the row with the
largest page_id is a response, the others revisit it; smaller payloads are all
responses. Payloads are equal when SHA-1 and length agree.

Nulls and edges: null html counts as an empty payload; rows that repeat both
page_id and payload of the response are responses too; a null page_id is kept and
is never larger than another; an empty table gives no archive and an empty
result. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import among, fresh_path, materialise, table

MANIFEST = "path string, records long"
INDEX = "path string, offset long, length long, record_type string, record_id string, uri string, digest string"
READ_BYTES = 1 << 20


def assign_types(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """pages with payload_bytes, digest and refers_to (null for a response)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    size, digest = F.octet_length("html").cast("long"), F.sha1("html")
    same = pages.select("page_id", size.alias("_bytes"), digest.alias("_digest")).where(F.col("_bytes") >= min_revisit)
    same = same.groupBy("_digest", "_bytes").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = materialise(same, "warc-same")
    pages = pages.withColumns({"payload_bytes": size, "digest": digest})
    repeated = among(same, F.xxhash64("_digest", "_bytes"))(F.xxhash64("digest", "payload_bytes"))
    # only pages whose payload may occur again meet the table of payloads that do
    found = pages.where(repeated).join(same, (F.col("digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    columns = ["page_id", "url", "html", "payload_bytes", "digest"]
    rest = pages.where(~repeated).select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return found.select(*columns, F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to")).unionByName(rest)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url or "", safe="/:?#[]@!$&'()*+,;=%"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head["Content-Length"] = str(len(block))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if ": " in line)


def records(chunks):
    """Whole records, one after the other, of inflated bytes that arrive in pieces."""
    held = bytearray()
    need = None  # of the record that is being read
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_headers(bytes(held[:end]))["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive ends inside a record")


def _inflated(stream):
    inflate = zlib.decompressobj(31)
    while raw := stream.read(READ_BYTES):
        while raw:
            yield inflate.decompress(raw, READ_BYTES)
            raw = inflate.unconsumed_tail
            if inflate.eof:  # a further stream in the same file
                raw, inflate = inflate.unused_data, zlib.decompressobj(31)
    yield inflate.flush()


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _writer(folder: str, records_per_file: int, level: int):
    def run(batches):
        fs, base = _place(folder)
        out = name = None
        written = 0

        def done():
            out.write(deflate.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name, written, deflate = f"{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(deflate.compress(record(page_id, url, text.encode(), digest, refers_to)))
                written += 1
                if written == records_per_file:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str, records_per_file: int = 5000, level: int = 1) -> DataFrame:
    """Monolithic archives of pages as assign_types gives them: path (in folder), records."""
    return materialise(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_writer(folder, records_per_file, level), MANIFEST), "warc-manifest")


def _normaliser(folder: str, to: str, level: int):
    def run(batches):
        fs, base = _place(folder)
        fs_to, base_to = _place(to)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{path.removesuffix('.warc.gz')}-{uuid.uuid4().hex}"
                fs_to.create_dir(f"{base_to}/index", recursive=True)
                offset = n = 0
                with fs.open_input_stream(f"{base}/{path}", compression=None) as source, fs_to.open_output_stream(f"{base_to}/{name}.warc.gz", compression=None) as out, fs_to.open_output_stream(f"{base_to}/index/{name}.json", compression=None) as index:
                    for raw in records(_inflated(source)):
                        head = _headers(raw[: raw.index(b"\r\n\r\n")])
                        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflate.compress(raw) + deflate.flush()
                        out.write(member)
                        index.write(json.dumps({"path": f"{name}.warc.gz", "offset": offset, "length": len(member), "record_type": head["WARC-Type"], "record_id": head["WARC-Record-ID"], "uri": head["WARC-Target-URI"], "digest": head["WARC-Payload-Digest"]}).encode() + b"\n")
                        offset += len(member)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def normalise(archives: DataFrame, folder: str, to: str, level: int = 3) -> DataFrame:
    """Archives with a member per record, and sidecar indexes in to/index: path (in to), records."""
    n = max(1, archives.count())  # a task for each archive
    return materialise(archives.select("path").repartition(n).mapInArrow(_normaliser(folder, to, level), MANIFEST), "warc-normal")


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """The sidecar rows of the archives in the manifest."""
    index = archives.sparkSession.read.schema(INDEX).json(f"{folder}/index")
    return index.join(archives.select(F.col("path").alias("_path")), F.col("path") == F.col("_path"), "left_semi")


def _reader(folder: str):
    def run(batches):
        fs, base = _place(folder)
        path = source = None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if name != path:
                    if source is not None:
                        source.close()
                    path, source = name, fs.open_input_file(f"{base}/{name}")
                source.seek(offset)
                raw = zlib.decompress(source.read(length), 31)
                end = raw.index(b"\r\n\r\n")
                head, block = _headers(raw[:end]), raw[end + 4 : -4]
                http_end = block.index(b"\r\n\r\n")
                payload = block[http_end + 4 :] if head["WARC-Type"] == "response" else None
                digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{name} at {offset}: the payload does not have its digest")
                number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
                rows.append({"page_id": number(head["WARC-Record-ID"]), "payload_bytes": int(_headers(block[:http_end])["Content-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")), "uri": head["WARC-Target-URI"], "payload": payload})
            yield pa.RecordBatch.from_pylist(rows, READ_ARROW)

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary"
READ_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload", pa.binary())])


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that the index rows point to, with payload (null for revisits) and digests checked."""
    places = index.select("path", "offset", "length")
    if with_payload:
        return places.mapInArrow(_reader(folder), READ)
    return places.mapInArrow(_without_payload(_reader(folder)), READ.rsplit(",", 1)[0])


def _without_payload(read):
    def run(batches):
        for batch in read(batches):
            yield batch.select(READ_ARROW.names[:-1])

    return run


def _delete(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def round_trip(pages: DataFrame, min_revisit: int = 1000, records_per_file: int = 5000) -> DataFrame:
    """Write pages, normalise the archives, and read every record back by the index."""
    spark = pages.sparkSession
    raw, normal = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    archives = normalise(write_archives(assign_types(pages, min_revisit), raw, records_per_file), raw, normal)
    _delete(spark, raw)  # the manifest of the normal archives is written: nothing reads these again
    if archives.isEmpty():
        return spark.createDataFrame([], READ.rsplit(",", 1)[0])
    return read_records(read_index(archives, normal), normal, with_payload=False)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
