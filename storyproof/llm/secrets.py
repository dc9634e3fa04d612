"""Secret scans: an Aho-Corasick pass finds keywords, anchored expressions look only there, checksums decide.

Everything works on the UTF-8 bytes of a text (all patterns are ASCII, and so is the folding of case); only the few spans
found are turned into code points. A scan is a map over rows: nothing is shuffled, and a hot source costs what its text costs.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.llm.common import arrow_map, documents, payloads

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _crc_base62(found: re.Match) -> bool:
    """The last six characters are the CRC-32 of those between the prefix and them, in base 62."""
    body, check = found[1], found[2]
    n, digits = zlib.crc32(body), bytearray()
    while n:
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return bytes(digits[::-1]).rjust(6, b"0") == check


def _jwt(found: re.Match) -> bool:
    """Header and payload are JSON objects, and the header names an algorithm."""
    try:
        parts = [json.loads(base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4))) for x in found[0].split(b".")[:2]]
    except (ValueError, RecursionError):  # no base64, no JSON, or JSON too deep to be a header
        return False
    return all(isinstance(x, dict) for x in parts) and "alg" in parts[0]


def _der(found: re.Match) -> bool:
    """The base64 body is one DER sequence whose length field equals what follows it (or an OpenSSH key)."""
    try:
        body = base64.b64decode(re.sub(rb"\s+", b"", found[1]), validate=True)
    except ValueError:
        return False
    if body.startswith(b"openssh-key-v1\0"):
        return True
    if len(body) < 2 or body[0] != 0x30:
        return False
    if body[1] < 0x80:
        return body[1] + 2 == len(body)
    n = body[1] & 0x7F
    return 0 < n <= 4 and int.from_bytes(body[2 : 2 + n]) + 2 + n == len(body)


def _base58check(found: re.Match) -> bool:
    """The last four bytes are the head of the double SHA-256 of the others."""
    n = 0
    for c in found[0]:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8)
    return raw[:-4] and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


class Kind(NamedTuple):
    """A kind of secret: keywords in lower case, the expression anchored where one begins, and whether a match counts."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]


ANY = lambda found: True
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE), lambda m: len(m[2]) >= 6),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Kind("hex", (), HEX, ANY),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])"), _crc_base62),
    Kind("npm", ("npm_",), re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])"), _crc_base62),
    Kind("jwt", ("eyj",), re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"), _jwt),
    Kind("pem", ("-----begin",), re.compile(rb"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ )?PRIVATE KEY-----"), _der),
    Kind("wif", ("wif:", "wif=", "privkey:", "privkey="), re.compile(rb"(?<=[:=])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![1-9A-HJ-NP-Za-km-z])"), _base58check),
    Kind("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(rb"xox[bpars]-[0-9]{6,}(?:-[0-9A-Za-z]{6,})+"), ANY),
    Kind("google", ("aiza",), re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), ANY),
    Kind("stripe", ("sk_live_", "rk_live_"), re.compile(rb"[sr]k_live_[0-9A-Za-z]{24,}"), ANY),
)
BASE = 3
AFTER = {"wif"}  # kinds whose secret begins where the keyword ends
#: Kinds that begin with a run of characters which must end in a certain way: where one doesn't, no later start within the run
#: can match either, so that the run is read once however many keywords it holds. By kind the exact keyword and the run.
RUNS = {"jwt": (b"eyJ", re.compile(rb"[A-Za-z0-9_-]+"))}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    users: dict[str, list[int]] = {}
    for i, kind in enumerate(KINDS):
        for word in kind.keywords:
            users.setdefault(word, []).append(i)
    for word, kinds in users.items():
        out.add_word(word, (len(word), kinds))
    out.make_automaton()
    return out


_automata: list[ahocorasick.Automaton] = []


def spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start byte, number of the kind, end byte) of each secret, sorted; those of one kind don't overlap."""
    if not _automata:
        _automata.append(_automaton())
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    hits = sorted((end + 1 - n * (KINDS[k].name not in AFTER), k) for end, (n, kinds) in _automata[0].iter(text.lower().decode("latin-1")) for k in kinds)
    free = [0] * len(KINDS)
    for start, k in hits:
        if start < free[k]:
            continue
        if m := KINDS[k].pattern.match(text, start):
            free[k] = m.end()
            if KINDS[k].valid(m):
                out.append((start, k, m.end()))
        elif (run := RUNS.get(KINDS[k].name)) and text.startswith(run[0], start):
            free[k] = run[1].match(text, start).end()
    return sorted(out)


def in_code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans, counted in code points."""
    if not found or text.isascii():
        return found
    at, points, seen = 0, {}, 0
    for p in sorted({p for s, _, e in found for p in (s, e)}):
        seen += sum(map(len, text[at:p].translate(None, bytes(range(0x80, 0xC0))).split(b"\n"))) + text.count(b"\n", at, p)
        at, points[p] = p, seen
    return [(points[s], k, points[e]) for s, k, e in found]


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id and spans, an array of (kind, start, end) in code points.

    Null or empty texts have no spans; texts of any length are scanned whole. Repeated rows keep their rows, a null doc_id is
    carried along, an empty table gives none. Other columns of docs are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[(KINDS[k].name, s, e) for s, k, e in in_code_points(x, spans(x))] for x in payloads(b.column(1))]
            rows = [[dict(zip(("kind", "start", "end"), y, strict=True)) for y in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: bytes) -> tuple[bytes, int]:
    """The text with each secret, or run of overlapping ones, replaced by the first one's kind in brackets; how many there were."""
    out, at, held = [], 0, spans(text)
    for start, k, end in held:
        if start >= at:
            out += [text[at:start], b"[", KINDS[k].name.encode(), b"]"]
        at = max(at, end)
    return b"".join([*out, text[at:]]), len(held)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced; n_chars, where there is such a column, is counted anew.

    All rows and columns stay, in their order: null and empty texts as they are, repeated rows as often as they come. An empty
    table gives none.
    """
    schema = docs.schema
    text = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text)
            made = [redact(x)[0].decode("utf-8", "replace") if valid else None for x, valid in zip(payloads(column), column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:text], pa.array(made, pa.string()), *b.columns[text + 1 :]], b.schema.names)

    out = arrow_map(docs, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over documents, digested; null and empty texts have zeros, the digest of nothing and no spans."""
    found = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in KINDS[:BASE]]))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k.name) for k in KINDS[:BASE]), F.sha2(line(base), 256).alias("base_sha256"), line("spans").alias("spans"))
