"""Removal of repeated byte strings: suffixes are sorted blockwise, and a difference cover says which can tie for long.

A string of LENGTH bytes is repeated if two suffixes of the corpus agree that far. Sorting all suffixes would move many times the
corpus, so the work goes as in blockwise suffix sorting with a difference cover:

1. The cover sample. D is a difference cover of period V: for any two positions there is a shift below V that puts both at
   offsets in D (modulo V, within their documents). So two suffixes that agree for LENGTH bytes have, within their first V
   positions, sample suffixes at the same shift, which agree for at least LENGTH - V + 1 bytes. The sample suffixes, about 9 in 100,
   are dealt into buckets by a hash of that many bytes, one bucket is sorted at a time, and each learns whether it ties.
2. Suffixes. Only a position with a tying sample suffix in its first V positions can begin a repeated string. Those alone are
   dealt into buckets, again sorted one at a time, by a hash of their LENGTH bytes; those that tie there are the repeated ones.
3. Each text loses the bytes that its repeated strings cover.

What order ties have doesn't matter here, only whether there is one, so buckets are of hashes instead of first letters, and a
common beginning is no hot bucket. A block of texts sends each of its keys once, so a string with any number of copies is one
key a block. Texts are never shuffled: blocks are stored rows, and what a bucket found goes back to its blocks as one bit a
key, in files by block that the tasks read from the shared folder. Of equal whole texts the first sends keys for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.llm.common import arrow_map, documents, mixed, payloads, ship
from storyproof.sources.store import materialize, new_path

LENGTH = 400
#: The order r of the difference cover: its period is 24 r² + 36 r + 13, and it has 6 r + 4 members.
ORDER = 2
#: Bytes of text of a block (or one longer text), positions hashed at a time, keys that a bucket holds on average (four times as
#: many if all positions can begin a repeated string), and those of them that are sorted at a time.
BLOCK_BYTES, CHUNK, KEYS, SORTED = 2 << 20, 1 << 18, 2_000_000, 500_000
LEAST_BUCKETS = 32
#: Blocks whose flags a task holds at a time.
HELD = 16
BLOCK = "block long, doc_ids array<long>, ends array<long>, data binary"
SENT = "bucket int, block long, keys binary"
FLAGS = "bucket int, block long, shared binary, first binary"
REPEATS = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

_random = np.random.default_rng(11)
_VALUES = _random.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASES = [int(x) for x in _random.integers(0, 1 << 64, 2, dtype=np.uint64) | np.uint64(5)]


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """(period, members): each number below the period is a difference of two members, modulo the period.

    The members are the partial sums of a run of gaps that covers 24 r² + 36 r + 13 differences with 6 r + 4 members.
    """
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *gaps])


@lru_cache(maxsize=4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        ones = lambda x: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, dtype=np.uint64)]))
        return ones(np.uint64(_BASES[which])), ones(np.uint64(pow(_BASES[which], -1, 1 << 64)))


def hashes(data: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    """The 64-bit hash of the length bytes from each of the sorted positions on; which is the hash function, 0 or 1."""
    out = np.empty(len(at), dtype=np.uint64)
    up, down = _powers(which, CHUNK + max(length, LENGTH))
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), CHUNK):
            a, b = np.searchsorted(at, [lo, lo + CHUNK])
            if a == b:
                continue
            part = data[lo : lo + CHUNK + length]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_VALUES[which][part] * up[: len(part)], out=sums[1:])
            p = at[a:b] - lo
            out[a:b] = mixed((sums[p + length] - sums[p]) * down[p])
    return out


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    """A bucket below n for each hash, by its upper half."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


class Keys:
    """The keys of a block: bucket and key of each distinct one, place the distinct one of each, least and n the first and the number of each distinct one's."""

    def __init__(self, bucket: np.ndarray, key: np.ndarray):
        order = np.lexsort([key, bucket])
        b, k = bucket[order], key[order]
        new = np.ones(len(b), dtype=bool)
        new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(new)
        self.bucket, self.key, self.least, self.n = b[first], k[first], order[first], np.diff(np.append(first, len(b)))
        del b, k, first
        self.place = np.empty(len(order), dtype=np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - 1

    def sent(self, block: int) -> pa.RecordBatch:
        """SENT rows: the distinct keys of each bucket."""
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        ends = np.append(cuts, len(self.key))[1:].tolist()
        rows = [self.key[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(self.bucket[cuts], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "block", "keys"])

    def found(self, bits: dict[int, bytes]) -> np.ndarray:
        """What the buckets say of each distinct key."""
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        sizes = np.diff(np.append(cuts, len(self.key))).tolist()
        parts = [np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=n) for b, n in zip(self.bucket[cuts].tolist(), sizes, strict=True)]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def blocks(docs: DataFrame) -> DataFrame:
    """BLOCK rows of docs (doc_id, text), stored: whole texts in UTF-8 end to end, a null one is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, ids, held = TaskContext.get().partitionId() << 33, [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.array(x, pa.int64())) for x in (ids, ends)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists, pa.array([b"".join(texts)], pa.binary())], ["block", "doc_ids", "ends", "data"])

        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), payloads(b.column(1)), strict=True):
                if held and held + len(t) > BLOCK_BYTES:
                    yield row()
                    at, texts, ids, held = at + 1, [], [], 0
                texts.append(t)
                ids.append(doc_id)
                held += len(t) + 1
        if texts:
            yield row()

    return materialize(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, BLOCK), "blocks", compression="zstd", wide=True)


def shared(sent: DataFrame, width: int) -> str:
    """The folder of FLAGS for SENT rows of keys of so many bytes: for each key whether another block has it too, and whether this block is the first of those.

    A bucket is one group; about SORTED of its keys, a range of values that each block has in one piece, are sorted at once,
    however many keys a bucket has. FLAGS are stored by the upper bits of the block, which are those of the task that made it,
    in the order of blocks.
    """

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block").to_numpy()
        views = [x.as_buffer() for c in group.column("keys").chunks for x in c]
        by_block = np.argsort(block, kind="stable")
        keys = [np.frombuffer(views[i], dtype=f"<u{width}") for i in by_block.tolist()]
        ends = np.cumsum([len(k) for k in keys])
        tied, first = np.zeros(int(ends[-1]), dtype=bool), np.zeros(int(ends[-1]), dtype=bool)
        parts = -(-int(ends[-1]) // SORTED) or 1
        cuts = np.array([p * (1 << 8 * width) // parts for p in range(1, parts)], dtype=f"<u{width}")
        edges = [np.concatenate([[0], np.searchsorted(k, cuts), [len(k)]]).astype(np.int64) for k in keys]
        starts = ends - [len(k) for k in keys]
        for p in range(parts):
            joined = np.concatenate([k[e[p] : e[p + 1]] for k, e in zip(keys, edges, strict=True)])
            place = np.concatenate([np.arange(s + e[p], s + e[p + 1]) for s, e in zip(starts.tolist(), edges, strict=True)])
            order = np.argsort(joined, kind="stable")  # of equal keys the first block's comes first
            same = joined[order[1:]] == joined[order[:-1]]
            place = place[order]
            tied[place[1:]] = same
            first[place[:-1]] = same
        first &= ~tied
        bits = [pa.array([np.packbits(x).tobytes() for x in np.split(f, ends[:-1])], pa.binary()) for f in (tied | first, first)]
        return pa.table([group.column("bucket"), pa.array(block[by_block]), *bits], ["bucket", "block", "shared", "first"])

    ship(sent.sparkSession)
    made = sent.groupBy("bucket").applyInArrow(run, FLAGS).withColumn("part", F.shiftright("block", 33))
    path = new_path(sent.sparkSession, "flags")
    made.repartition("part").sortWithinPartitions("part", "block").write.partitionBy("part").options(**{"parquet.block.size": 4 << 20}).parquet(path)
    return path


class Flags:
    """Reads the FLAGS of a block; those of HELD blocks in a row are read together, and held until others are asked for."""

    def __init__(self, path: str, column: str = "shared"):
        self.path, self.column, self.part, self.found, self.range, self.held = path, column, -1, None, -1, {}

    def of(self, block: int) -> dict[int, bytes]:
        if self.part != block >> 33:
            self.part, self.found = block >> 33, None
            fs, path = pa.fs.FileSystem.from_uri(f"{self.path}/part={self.part}")
            if fs.get_file_info(path).type != pa.fs.FileType.NotFound:  # none of its blocks has keys
                self.found = pa.dataset.dataset(path, filesystem=fs, format="parquet")
        if self.range != block // HELD:
            self.range, self.held = block // HELD, {}
            if self.found is not None:
                at = pa.dataset.field("block")
                some = (at >= self.range * HELD) & (at < (self.range + 1) * HELD)
                for b in self.found.to_batches(columns=["block", "bucket", self.column], filter=some, batch_readahead=1, fragment_readahead=1, use_threads=False):
                    for at_block, bucket, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        self.held.setdefault(at_block, {})[bucket] = bits
        return self.held.get(block, {})


class Block:
    """A stored block: its texts end to end, where each begins and ends, and the steps of finding what is repeated in them."""

    def __init__(self, block: int, ends: pa.Array, data: bytes, length: int, order: int):
        self.block, self.length = block, length
        self.data, self.ends = np.frombuffer(data, dtype=np.uint8), ends.to_numpy().astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        while order and 24 * order * order + 36 * order + 13 > length // 2:  # short strings need a shorter period
            order -= 1
        self.period, self.members = difference_cover(order)
        if self.period > length:
            self.period, self.members = 1, np.zeros(1, dtype=np.int64)

    def text_keys(self, n: int) -> tuple[np.ndarray, Keys]:
        """The texts that can hold a repeated string, and their keys: hashes of the whole texts."""
        long = np.flatnonzero(self.ends - self.starts >= self.length)
        made = [xxhash.xxh3_128_intdigest(self.data[a:b]) for a, b in zip(self.starts[long].tolist(), self.ends[long].tolist(), strict=True)]
        high, low = (np.array([x >> s & (1 << 64) - 1 for x in made], dtype=np.uint64) for s in (64, 0))
        return long, Keys(_bucket(high, n), low)

    def copies(self, n: int, is_shared: dict[int, bytes], is_first: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text whether another text of the corpus is the same, and whether this one speaks for all of them."""
        long, keys = self.text_keys(n)
        tied, first = keys.found(is_shared), keys.found(is_first)
        copied, speaks = np.zeros(len(self.ends), dtype=bool), np.zeros(len(self.ends), dtype=bool)
        copied[long] = (tied | (keys.n > 1))[keys.place]
        speaks[long[keys.least]] = ~tied | first
        return copied, speaks

    def sample(self, speaks: np.ndarray, n: int) -> tuple[np.ndarray, Keys]:
        """The sample positions of the texts that speak, and their keys."""
        reach = self.length - self.period + 1
        within = np.zeros(self.period, dtype=bool)
        within[self.members] = True
        at = []
        for i in np.flatnonzero(speaks).tolist():
            a, b = int(self.starts[i]), int(self.ends[i]) - reach + 1
            at.append((a + np.arange(0, b - a, self.period)[:, None] + self.members).ravel())
            at[-1] = at[-1][at[-1] < b]
        at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        x = hashes(self.data, at, reach, 0)
        return at, Keys(_bucket(x, n), (x & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    def suffixes(self, speaks: np.ndarray, n_samples: int, sample_bits: dict[int, bytes], n: int) -> tuple[np.ndarray, Keys]:
        """The positions that can begin a repeated string, and their keys."""
        can = self._candidates(speaks, n_samples, sample_bits)
        return can, Keys(_bucket(hashes(self.data, can, self.length, 1), n), hashes(self.data, can, self.length, 0))

    def _candidates(self, speaks: np.ndarray, n_samples: int, sample_bits: dict[int, bytes]) -> np.ndarray:
        at, keys = self.sample(speaks, n_samples)
        ties = at[(keys.found(sample_bits) | (keys.n > 1))[keys.place]] if len(at) else at
        edge = np.zeros(len(self.data) + 1, dtype=np.int32)
        text = np.searchsorted(self.ends, ties, side="right")
        np.add.at(edge, np.maximum(ties - self.period + 1, self.starts[text]), 1)
        np.add.at(edge, ties + 1, -1)
        near = np.cumsum(edge, dtype=np.int32) > 0
        last = np.flatnonzero(self.ends - self.starts >= self.length)
        edge[:] = 0  # now of positions with enough bytes after them in their text
        np.add.at(edge, self.starts[last], 1)
        np.add.at(edge, self.ends[last] - self.length + 1, -1)
        near &= np.cumsum(edge, dtype=np.int32) > 0
        return np.flatnonzero(near)

    def covered(self, copied: np.ndarray, can: np.ndarray, keys: Keys, bits: dict[int, bytes]) -> np.ndarray:
        """For each byte whether a repeated string covers it."""
        begins = can[(keys.found(bits) | (keys.n > 1))[keys.place]] if len(can) else can
        edge = np.zeros(len(self.data) + 1, dtype=np.int32)
        edge[begins] += 1
        edge[begins + self.length] -= 1
        np.add.at(edge, self.starts[copied], 1)
        np.add.at(edge, self.ends[copied], -1)
        return np.cumsum(edge, dtype=np.int32)[:-1] > 0


def _spans(block: Block, doc_ids: pa.Array, covered: np.ndarray) -> pa.RecordBatch:
    """REPEATS rows of a block."""
    spans, kept = [], []
    for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
        inside = covered[a:b]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)
        spans.append([{"start": s, "end": e} for s, e in edges.tolist()])
        kept.append(block.data[a:b][~inside].tobytes() if len(edges) else block.data[a:b].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(block.ends - block.starts), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, length: int = LENGTH, order: int = ORDER) -> DataFrame:
    """REPEATS: one row for each row of docs (doc_id, text), the runs of bytes that repeated strings cover, and what is left without them.

    A string of length bytes within one text is repeated if it begins anywhere else, in the same text or another; strings may
    overlap and are judged on the texts as they come. A null text is empty; empty texts and those shorter than length lose
    nothing. Of repeated rows all are removed whole, if they are long enough. A null doc_id is carried along; other columns are
    ignored, whatever their names; an empty table gives none. kept is in bytes, since a run can end within a character. Strings
    are compared by two hashes, of 64 bits and of the bucket's number. A text is in memory whole, whatever its length.
    """
    rows = blocks(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.coalesce(F.sum(F.size("ends")), F.lit(0))).first()
    period, members = difference_cover(order)
    many = lambda keys: max(LEAST_BUCKETS, -(-int(keys) // KEYS))
    n_texts, n_samples, n_suffixes = many(total[1]), many(total[0] * len(members) / period), many(total[0] / 4)

    def keys_of(make: Callable[[Block], Keys]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    block = Block(b.column(0)[i].as_py(), b.column(1).slice(i, 1).flatten(), b.column(2)[i].as_buffer(), length, order)
                    yield make(block).sent(block.block)

        return arrow_map(rows.select("block", "ends", "data"), run, SENT)

    texts = shared(keys_of(lambda b: b.text_keys(n_texts)[1]), 8)
    spoken = lambda flags: lambda b: b.copies(n_texts, flags[0].of(b.block), flags[1].of(b.block))
    of_texts = spoken((Flags(texts), Flags(texts, "first")))
    samples = shared(keys_of(lambda b: b.sample(of_texts(b)[1], n_samples)[1]), 4)
    of_samples = Flags(samples)
    suffixes = shared(keys_of(lambda b: b.suffixes(of_texts(b)[1], n_samples, of_samples.of(b.block), n_suffixes)[1]), 8)
    of_suffixes = Flags(suffixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b.column(0)[i].as_py(), b.column(2).slice(i, 1).flatten(), b.column(3)[i].as_buffer(), length, order)
                copied, speaks = of_texts(block)
                can, keys = block.suffixes(speaks, n_samples, of_samples.of(block.block), n_suffixes)
                yield _spans(block, b.column(1).slice(i, 1).flatten(), block.covered(copied, can, keys, of_suffixes.of(block.block)))

    return arrow_map(rows, run, REPEATS)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeats() of all documents at 400 bytes."""
    found = repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS uid, doc_id, hex(coalesce(text, '')) AS h FROM documents
), places AS (
  SELECT uid, unnest(range(len(h) // 2 - {LENGTH} + 1)) AS i, h FROM texts WHERE len(h) >= {2 * LENGTH}
), strings AS (
  SELECT uid, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS s FROM places
), repeated AS (
  SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY s) AS n FROM strings) WHERE n > 1
), steps AS (
  SELECT uid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY uid ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM repeated
), runs AS (
  SELECT uid, min(i) AS a, max(i) + {LENGTH} AS b
  FROM (SELECT uid, i, sum(new) OVER (PARTITION BY uid ORDER BY i) AS run FROM steps) GROUP BY uid, run
), found AS (
  SELECT uid, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS removed FROM runs GROUP BY uid
), whole AS (
  SELECT doc_id, h, [0] || coalesce(b, []) AS b, coalesce(a, []) || [len(h) // 2] AS a, coalesce(removed, 0) AS removed FROM texts LEFT JOIN found USING (uid)
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, removed AS n_removed, (len(a) - 1)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda k: substr(h, 2 * b[k] + 1, 2 * (a[k] - b[k]))), ''))) AS kept_sha256
FROM whole
"""
