"""Repeated strings, ranked search and resampling against brute-force versions, with nulls, ties, repeated rows and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storyproof.llm import ranking, resampling, suffixes

r = random.Random(11)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = ["uid", "words", "pairs", "buckets", "score", "rank", "weight", "part", "before", "_at", "block", "ends", "data", "item", "kept", "a.b", "a`b"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES)).repartition(parts)


def keyed(df):
    return sorted((tuple(x.asDict().values()) for x in df.collect()), key=repr)


@pytest.mark.parametrize("order", range(5))
def test_difference_cover(order):
    period, members = suffixes.difference_cover(order)
    assert len(members) == 6 * order + 4 and {(a - b) % period for a in members.tolist() for b in members.tolist()} == set(range(period))


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = [m.span() for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        yield len(t), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)


@pytest.mark.parametrize("length", [1, 7, 40, 400])
def test_repeats(spark, length):
    some = lambda n: "".join(r.choice("abé日 ") for _ in range(n))
    passage, tandem = some(2 * length), "xyz" * length
    texts = [None, "", "a", some(length), passage, passage, some(30) + passage[3:] + some(50), passage[: length - 1], tandem, some(9) + passage[: length + 5], some(20) + passage[5:] + "!" + passage[:-4], "b" * (3 * length), "q" * (length // 2 + 1)]
    texts += [t + some(r.randrange(3)) for t in r.choices([some(3 * length) for _ in range(6)], k=20)]
    texts.append(" ".join(some(50) for _ in range(1500)))  # a long text
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    rows += rows[9:11]
    got = keyed(suffixes.repeats(frame(spark, rows), length))
    raw = [(t or "").encode() for _, t in rows]
    want = sorted(((i, n, [tuple(s) for s in spans], bytearray(kept)) for (i, _), (n, spans, kept) in zip(rows, brute_repeats(raw, length), strict=True)), key=repr)
    assert sorted(((i, n, [tuple(s) for s in spans], bytearray(kept)) for i, n, spans, kept in got), key=repr) == want
    assert suffixes.repeats(frame(spark, rows).limit(0), length).count() == 0


def test_window_hashes_cross_chunks(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(5000) * 2, dtype=np.uint8)
    at = np.arange(len(data) - 300 + 1)
    whole = suffixes.hashes(data, at, 300, 0)
    assert (whole[:4700] == whole[5000:9700]).all() and len(np.unique(whole[:5000])) == 5000
    monkeypatch.setattr(suffixes, "CHUNK", 777)
    assert (suffixes.hashes(data, at, 300, 0) == whole).all()


def brute_ranks(docs, items, top):
    words = [Counter(re.findall(WORD, low(t))) for _, t in docs]
    sizes = [sum(w.values()) for w in words]
    n, total, df = sum(x > 0 for x in sizes), sum(sizes), Counter(t for w in words for t in w)
    for item in sorted({i for i, _ in items if i is not None}):
        terms = {t for i, text in items if i == item for t in re.findall(WORD, low(text))}
        scored = []
        for (doc_id, _), w, size in zip(docs, words, sizes, strict=True):
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 8 * (10 + 90 * size * n // total))) for t in terms if w[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id))
        yield from ((item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top]))


@pytest.mark.parametrize("parts", [1, 4])
def test_ranked_search(spark, monkeypatch, parts):
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "ÀÉ", "the", "THE"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 30)))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 the") for i in range(30)] + docs[5:9] + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7000, None), (7001, ""), (7002, "... !"), (7003, "w1, " * 50_000)]
    items = [(f"i{i}", " ".join(r.choices(vocabulary, k=r.randrange(1, 12)))) for i in range(20)]
    items += [("none", None), ("empty", ""), ("unknown", "nowhere"), (None, "w1"), ("two", "w1"), ("two", "w2 w2"), ("ties", "w1 w2 the")]
    if parts > 1:
        monkeypatch.setattr(ranking, "TERMS", 40)
    got = keyed(ranking.rank(frame(spark, docs), frame(spark, items, "item_id string, text string")))
    assert got == sorted(brute_ranks(docs, items, 10), key=repr)
    nothing = frame(spark, docs).limit(0)
    assert ranking.rank(nothing, frame(spark, items, "item_id string, text string")).count() == 0
    assert ranking.rank(frame(spark, docs), frame(spark, items, "item_id string, text string").limit(0)).count() == 0


def test_selection_is_safe_for_ties():
    numbers = np.random.default_rng(3)
    for _ in range(500):
        n = int(numbers.integers(0, 40))
        scores, ids = numbers.integers(0, 4, n), numbers.integers(0, 15, n)
        got = ranking.best(scores, ids, 10)
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids, strict=True) if s > 0)[:10]
        assert [(-int(scores[k]), int(ids[k])) for k in got] == want and len(set(got.tolist())) == len(got)


def brute_resample(docs, target):
    def features(text):
        w = re.findall(WORD, low(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for text in target for b in features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((x for x in rows if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = 5 * len(able) // 100
    for k, x in enumerate(able):
        yield *x[:4], k + 1 if k < drawn else None
    yield from ((*x[:4], None) for x in rows if x[4] < 20)


def test_resample(spark):
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "日本", "ÀÉ", "THE"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 60)))) for i in range(400)]
    docs += docs[3:40] + docs[3:40] + [(900, None), (901, ""), (902, "one"), (903, "one Two"), (None, "x " * 25), (904, "w7,w8!" * 30_000)]
    target = [" ".join(r.choices(vocabulary[:30], k=40)) for _ in range(20)] + [None, ""]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert keyed(resampling.resample(frame(spark, docs), wanted)) == sorted(brute_resample(docs, target), key=repr)
    assert keyed(resampling.resample(frame(spark, docs), wanted.limit(0))) == sorted(brute_resample(docs, []), key=repr)
    assert resampling.resample(frame(spark, docs).limit(0), wanted).count() == 0


@pytest.mark.parametrize("stored", [suffixes.blocks, ranking.counted])
def test_few_wide_rows_are_in_memory(spark, stored, tmp_path):
    """A row of megabytes ends its row group soon: a writer holds a row group, and a reader has it in memory at once."""
    words = "array_join(transform(sequence(0, 399999), i -> conv((id * 104729 + i * 7919L) % 1000003, 10, 36)), ' ')"
    docs = spark.range(12, numPartitions=1).selectExpr("id AS doc_id", f"{words} AS text")
    made = stored(docs)
    groups = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for f in made.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
    assert sum(n for n, _ in groups) == made.count() >= 6
    assert len(groups) > 1 and max(size for _, size in groups) < 24 << 20


def test_flags_of_a_large_bucket(spark):
    """A bucket of more keys than are sorted at once says of each whether another block has it."""
    g = np.random.default_rng(5)
    common = g.integers(0, 1 << 64, 300_000, dtype=np.uint64)
    keys = {7: common[:200_000], 9: common[100_000:], 20: np.concatenate([common[150_000:150_010], g.integers(0, 1 << 64, 250_000, dtype=np.uint64)])}
    keys = {b: np.unique(k) for b, k in keys.items()}
    assert sum(map(len, keys.values())) > suffixes.SORTED
    path = suffixes.shared(spark.createDataFrame([(0, b, bytearray(k.tobytes())) for b, k in keys.items()], suffixes.SENT), 8)
    flags, first = suffixes.Flags(path), suffixes.Flags(path, "first")
    for b, k in keys.items():
        others = [np.isin(k, o) for c, o in keys.items() if c != b]
        before = [np.isin(k, o) for c, o in keys.items() if c < b] or [np.zeros(len(k), dtype=bool)]
        bits = lambda f, n=len(k), b=b: np.unpackbits(np.frombuffer(f.of(b)[0], dtype=np.uint8), count=n).astype(bool)
        assert (bits(flags) == np.any(others, axis=0)).all()
        assert (bits(first) == (np.any(others, axis=0) & ~np.any(before, axis=0))).all()


def test_resample_makes_buckets_once(spark, monkeypatch):
    plans = {}
    kept = resampling.materialize
    monkeypatch.setattr(resampling, "materialize", lambda df, name, **more: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), kept(df, name, **more))[1])
    resampling.resample(frame(spark, [(1, "a b c " * 9), (2, None)]), spark.createDataFrame([("b c",)], "text string")).count()
    assert "crc32" in plans["buckets"] and "crc32" not in plans["scored"]
