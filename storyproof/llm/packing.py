"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Tokens are made once, where the text is read; what travels from there on is a few numbers a piece. The packing itself is
decided for all pieces at once, but on their histogram: there are at most as many lengths as the capacity, so the plan is
made on the driver from at most that many rows, whatever the corpus holds, and has a proven number of entries.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyproof.llm.common import arrow_map, documents, materialize

CAPACITY, EOD = 2048, 0
CACHED_WORDS = 200_000


class Known(dict):
    """The ids of each part of a text met so far."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.encode(part), dtype="<u4").tobytes()
        if len(part) < 64:
            self[part] = ids
        return ids


class Ids:
    """Token ids of a text as little-endian 32-bit bytes, from a byte-level BPE file of the `tokenizers` library.

    The texts are split as the file's byte-level pre-tokenizer does; the ids of each part are kept, since parts recur. A new
    part is merged with the vocabulary and ranks of the same file. The string of an added token is that token wherever it
    stands, of several the longest, as in the library's defaults; the text between is split for itself.
    """

    # The split pattern of byte-level BPE vocabularies of this family.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    # The same for texts where letters, digits and space mean the same to the faster `re`: UNSURE finds all others.
    FAST = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+|\s+(?!\S)|\s+")
    UNSURE = re.compile(r"[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        back = {c: b for b, c in self._bytes_to_chars().items()}
        added = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        if file.get("normalizer") or any(t.get(x) for t in file.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has a normalizer, or added tokens that aren't plain strings")
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(back[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in added}
        self.slow = regex.compile(self.PATTERN)
        self.encoding = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = Known(self.encoding.encode_ordinary)

    @staticmethod
    def _bytes_to_chars() -> dict[int, str]:
        """The printable stand-in of each byte in such vocabulary files."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __call__(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return b"".join(self.added.get(x) or self._plain(x) for x in self.special.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        parts = (self.slow if self.UNSURE.search(text) else self.FAST).findall(text)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, parts))


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity where there are several."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth numbers the pieces of one length within the reading task part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = ids_of(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([EOD], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """How pieces of each length are dealt to sequences: (length, first rank, first sequence, pieces a sequence, offset).

    The pieces of one length are numbered from 0; an entry holds from its first rank to that of the next entry of its
    length. Lengths over a third of the capacity are matched, at most two to a sequence: from the longest, each takes the
    longest partner that fits. The rest go, longest first, to the sequence with the smallest gap that holds them, and open a
    new one only where none does. Sequences with equal gaps are handled as one group, whose gap drops below the length just
    placed each time it is used, so it at least halves; groups split once a length at most, which bounds groups and entries by
    a multiple of the number of lengths, whatever the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    ranks = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    gaps: list[int] = []
    opened = 0

    def place(length: int, first: int, sequences: int, each: int, offset: int) -> None:
        out.append((length, ranks[length], first, each, offset))
        ranks[length] += sequences * each
        left[length] -= sequences * each
        if not left[length]:
            del left[length]

    def keep(gap: int, first: int, sequences: int) -> None:
        if gap and sequences:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append((first, sequences))

    def drop(gap: int) -> tuple[int, int]:
        group = groups[gap].pop()
        if not groups[gap]:
            del groups[gap]
            gaps.remove(gap)
        return group

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if n not in left:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1
        while at >= 0 and large[at] not in left:
            del large[at]
            at -= 1
        partner = large[at] if at >= 0 else None
        if partner is None or (partner == n and left[n] == 1):
            many = left[n]
            place(n, opened, many, 1, 0)
            keep(capacity - n, opened, many)
        elif partner == n:
            many = left[n] // 2
            place(n, opened, many, 2, 0)
            keep(capacity - 2 * n, opened, many)
        else:
            many = min(left[n], left[partner])
            place(n, opened, many, 1, 0)
            place(partner, opened, many, 1, n)
            keep(capacity - n - partner, opened, many)
        opened += many
    for n in sorted(left, reverse=True):
        while n in left:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                many = left[n] // each
                if many:
                    place(n, opened, many, each, 0)
                    keep(capacity - each * n, opened, many)
                    opened += many
                elif rest := left[n]:
                    place(n, opened, 1, rest, 0)
                    keep(capacity - rest * n, opened, 1)
                    opened += 1
                continue
            gap = gaps[at]
            first, sequences = drop(gap)
            each = gap // n
            many = min(sequences, left[n] // each)
            if many:
                place(n, first, many, each, capacity - gap)
                keep(gap - each * n, first, many)
            if many < sequences:
                rest = min(left.get(n, 0), each - 1)
                if rest:
                    place(n, first + many, 1, rest, capacity - gap)
                    keep(gap - rest * n, first + many, 1)
                    many += 1
                keep(gap, first + many, sequences - many)
    return sorted(out)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty texts are one piece, the closing id alone. Repeated rows are packed as often as they come; a null doc_id
    is carried along. Texts of any length are tokenized whole. Equal lengths are placed in the order of their reading tasks. Other
    columns of docs are ignored, whatever their names. An empty table gives none.
    """
    made = materialize(pieces(docs, tokenizer, capacity), "pieces")
    held = materialize(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries = np.array(plan(counts, capacity) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
    bits = 44
    assert max(counts.values(), default=0) < 1 << bits
    keys = (entries[:, 0] << bits) + entries[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (b.schema.get_field_index("length"), b.schema.get_field_index("rank")))
            at = np.searchsorted(keys, (length << bits) + rank, side="right") - 1
            nth, each = rank - entries[at, 1], entries[at, 3]
            placed = [pa.array(entries[at, 2] + nth // each), pa.array(entries[at, 4] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(b.columns[:5] + placed, [*b.schema.names[:5], "sequence_id", "offset"])

    before = held.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = made.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return arrow_map(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() over documents with 2048 tokens a sequence; null and empty texts are the closing id alone."""
    return pack(documents(spark, sf_dir), tokenizer_path())
