"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame.

Which page keeps its payload is decided on rows of digests without payloads; the pages are then written where they are read,
each task to files of its own in the shared folder. A task that is lost or repeated leaves files that the manifest, written by Spark at the end of the
job, doesn't name, and nothing reads those.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.llm.common import arrow_map, bounded, materialize
from storyproof.sources.store import new_path

# Fixed values of the formats: frame magics and record lines.
DICTIONARY_FRAME, DATA_FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

FILE_BYTES = 64 << 20
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 16 << 10, 400, 2 << 20
DICTIONARY_MOST = 64 << 20
READ_BYTES = 1 << 16
#: So many digests that several rows share, and so many bytes of their addresses, are sent to all tasks; more are joined by a shuffle.
SHARED_ROWS, SHARED_BYTES = 500_000, 32 << 20
#: Numbers in headers: what a 64-bit integer holds.
NUMBER, MOST = re.compile(r"-?[0-9]{1,19}"), (1 << 63) - 1
RECORD_ID = re.compile(r"<urn:uuid:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}>")
WHEN = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?Z")
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block_bytes long, file string, problem string"


class Damaged(ValueError):
    """An archive or record that breaks a rule of the format."""


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None, sha1_hex: str) -> str:
    """The id of the only response of a payload, which its revisits can name as well."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {sha1_hex}')}>"


def _uri(url: str | None) -> str:
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "urn:none"


def build(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, size: int, first: tuple[int, str | None, bool] | None = None, only: bool = True) -> bytes:
    """One record: headers, block, closing lines.

    first is (page_id, url, whether it is the only one) of the response that a revisit refers to; a revisit has the HTTP
    headers of the page as its block, and no payload. only says that no other response has this page_id and payload.
    """
    block = HTTP.format(size).encode() + (b"" if first else payload)
    own = record_id(page_id, sha1_hex) if only and not first else f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{base32(sha1_hex)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _uri(first[1])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(first[0]))]
        if first[2]:
            fields.append(("WARC-Refers-To", record_id(first[0], sha1_hex)))
    fields.append(("Content-Length", str(len(block))))
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", block, b"", b""])


class Writer:
    """An archive file; its dictionary comes from the first records, which are held until there are enough."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.held, self.size, self.coder, self.bytes = stream, [], 0, None, 0

    def add(self, record: bytes) -> None:
        if self.coder:
            self._write(self.coder.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if len(self.held) >= SAMPLE_RECORDS or self.size >= SAMPLE_BYTES:
            self._begin()

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        try:
            held = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:20_000] for r in self.held]).as_bytes()
        except zstandard.ZstdError:  # too few or too small records to train on: their text is the dictionary
            held = b"".join(self.held)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"
        self._write(struct.pack("<II", DICTIONARY_FRAME, len(held)) + held)
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=True)
        for r in self.held:
            self._write(self.coder.compress(r))
        self.held = []

    def close(self) -> None:
        if not self.coder:
            self._begin()
        self.stream.close()


def frames(stream: pa.NativeFile) -> Iterator[bytes]:
    """The content of each data frame of an archive, read a small part at a time."""
    data = stream.read(8)
    if len(data) < 8 or (head := struct.unpack("<II", data))[0] != DICTIONARY_FRAME:
        raise Damaged("no dictionary in a leading skippable frame")
    if head[1] > DICTIONARY_MOST:
        raise Damaged("the dictionary is empty or too large")
    held = stream.read(head[1])
    if len(held) != head[1]:
        raise Damaged("the dictionary ends early")
    if held[:4] == struct.pack("<I", DATA_FRAME):  # the dictionary itself may be compressed
        try:
            held = zstandard.ZstdDecompressor().stream_reader(held).read(DICTIONARY_MOST + 1)
        except zstandard.ZstdError as e:
            raise Damaged(f"the dictionary can't be decoded: {e}") from e
        if not 0 < len(held) <= DICTIONARY_MOST:
            raise Damaged("the dictionary is empty or too large")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    rest = b""
    while True:
        rest = rest or stream.read(READ_BYTES)
        if not rest:
            return
        while len(rest) < 8 and (more := stream.read(READ_BYTES)):
            rest += more
        if len(rest) >= 8 and struct.unpack("<I", rest[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:
            left = struct.unpack("<I", rest[4:8])[0] + 8
            while len(rest) < left:
                left -= len(rest)
                if not (rest := stream.read(READ_BYTES)):
                    raise Damaged("a skippable frame ends early")
            rest = rest[left:]
            continue
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(READ_BYTES)):
                raise Damaged("a frame ends early")
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise Damaged(f"a frame can't be decoded: {e}") from e
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """The fields of RECORD but file; Damaged if headers, lengths or digest are wrong."""
    head, split, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not split or lines[0] != VERSION:
        raise Damaged("no version line or end of the headers")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip() or name.lower() in fields:
            raise Damaged(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    if missing := [x for x in REQUIRED if x not in fields]:
        raise Damaged(f"no {', '.join(missing)}")
    if not RECORD_ID.fullmatch(fields["warc-record-id"]) or not RECORD_ID.fullmatch(fields.get("warc-refers-to", fields["warc-record-id"])):
        raise Damaged("a record id that is no <urn:uuid:…>")
    for name in ("warc-date", "warc-refers-to-date"):
        if not _date(fields.get(name, DATE)):
            raise Damaged(f"{name} is no time in UTC: {fields[name][:40]!r}")
    if _number(fields, "content-length") != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise Damaged("the block isn't as long as Content-Length says")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise Damaged(f"unknown type {kind}")
    http, split, payload = rest[:-4].partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
    if not split or not http.startswith(b"HTTP/") or not found:
        raise Damaged("no HTTP headers in the block")
    size = int(found[1])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise Damaged("the payload has another length or digest than its headers say")
    if kind == "revisit" and payload:
        raise Damaged("a revisit with a payload")
    return {"page_id": _number(fields, "x-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _number(fields, "x-refers-to-page-id"), "block_bytes": _number(fields, "content-length"), "problem": None}


def _date(text: str) -> bool:
    """Whether a text is a time in UTC as the format writes it, with up to nine digits after the second."""
    if not WHEN.fullmatch(text):
        return False
    try:
        datetime.strptime(text[:19], "%Y-%m-%dT%H:%M:%S")
    except ValueError:
        return False
    return True


def _number(fields: dict[str, str], name: str) -> int | None:
    """The number that a header holds, none if it is absent or empty; Damaged if it is anything else."""
    said = fields.get(name)
    if not said:
        return None
    if not NUMBER.fullmatch(said) or not -MOST - 1 <= int(said) <= MOST:
        raise Damaged(f"{name} is no number: {said[:40]!r}")
    return int(said)


def decide(pages: DataFrame, least: int) -> DataFrame:
    """pages as (page_id, url, html, sha1, size), with first, the response (page_id, url, only) that a revisit refers to, and only.

    The smallest page_id of each digest is found on rows of digests. Only digests that several rows have go back to the pages:
    their number is checked, and while it is within SHARED_ROWS they are sent to where the pages are read, so that no payload
    is shuffled; beyond it, pages are joined by digest.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    each = hashed.groupBy("sha1", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "n")))
    shared = materialize(each.groupBy("sha1").agg(F.sum("n").alias("rows"), first.alias("head")).where("rows > 1").select("sha1", F.col("head.page_id").alias("first_id"), F.col("head.url").alias("first_url"), (F.col("head.n") == 1).alias("first_only")), "shared-payloads")
    known = F.broadcast(shared) if bounded(shared, SHARED_ROWS, SHARED_BYTES, "first_url") else shared
    same = F.col("page_id").eqNullSafe(F.col("first_id"))
    revisit = F.col("first_id").isNotNull() & ~same & (F.col("size") >= least)
    joined = hashed.join(known.withColumn("found", F.lit(True)), "sha1", "left")
    return joined.withColumns({"first": F.when(revisit, F.struct("first_id", "first_url", "first_only")), "only": F.col("found").isNull() | (same & F.col("first_id").isNotNull() & F.col("first_only"))})


def write(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """Writes archives of pages (page_id, url, html) into a new folder; gives the folder and its manifest (file, records, bytes).

    The folder is in the shared one and goes when this process ends; who wants to keep the archives moves them.

    Of rows with equal payloads of at least that many bytes, those with the smallest page_id are responses and the others
    revisits. Rows repeated whole, page_id included, are alike responses or alike revisits. A null html is an empty payload; a
    null page_id is never the smallest, unless no other row has the payload: then all its rows are responses. An empty table
    gives no files. Other columns of pages are ignored, whatever their names.
    """
    folder = new_path(pages.sparkSession, "warc")
    rows = decide(pages, least).select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).cast("binary").alias("html"), "sha1", "size", "first", "only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    fs, path = pa.fs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    made.append([f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0])
                    writer = Writer(fs.open_output_stream(f"{path}/{made[-1][0].rpartition('/')[2]}", compression=None))
                page_id, url, html, sha1, size, first, only = row
                writer.add(build(page_id, url, html or b"", sha1, size, tuple(first.values()) if first else None, only))
                made[-1][1] += 1
                if writer.bytes >= FILE_BYTES:
                    writer.close()
                    made[-1][2], writer = writer.bytes, None
        if writer is not None:
            writer.close()
            made[-1][2] = writer.bytes
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "records", "bytes"])

    return folder, materialize(arrow_map(rows, run, "file string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """RECORD rows, one for each record of the files that a manifest (file, ...) names, a file a task at a time.

    A record that breaks a rule has the problem and nulls; a file that can't be decoded further has one such row and ends. A
    null file is one row with a problem; a file named twice is read twice. A file that isn't there fails the job, as other
    errors of the storage do. An empty manifest gives no rows; its other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RECORD.split(", ")]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for b in batches:
            for file in b.column(0).to_pylist():
                if file is None:
                    yield batch([{"problem": "no file is named"}])
                    continue
                fs, path = pa.fs.FileSystem.from_uri(file)
                rows: list[dict] = []
                with fs.open_input_stream(path, compression=None) as stream:
                    content = frames(stream)
                    while True:
                        try:
                            record = next(content)
                        except StopIteration:
                            break
                        except Damaged as e:
                            rows.append({"file": file, "problem": str(e)})
                            break
                        try:
                            rows.append({"file": file} | parse(record))
                        except Damaged as e:
                            rows.append({"file": file, "problem": str(e)})
                        if len(rows) >= 2000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    files = manifest.select("file")
    n = max(1, files.count())
    return arrow_map(files.repartition(min(n, 10_000)), run, RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say when they are read back; null html is an empty payload."""
    _, manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sql() -> str:
    digit = "+".join(f"CAST(substr(bits, i * 5 + {k + 1}, 1) AS INTEGER) * {16 >> k}" for k in range(5))
    return f"""
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM payloads),
texts AS (SELECT page_id, payload_bytes, hex, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits FROM digests),
digits AS (SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {digit}, 1)), '') AS payload_digest FROM texts),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM digits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""


SQL = _sql()
