"""The queries over a small folder of tables with nulls, empty and very long texts, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from storyproof.llm import licenses, queries, secrets
from tests.llm.test_llm import WORD, low

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["uid", "fp", "score", "kept", "n_words", "spans", "length", "rank", "key", "low", "line", "size", "entities", "label", "words", "pairs", "buckets", "weight", "part", "before", "_at", "block", "ends", "data", "item"]
r = random.Random(9)
LONG = " ".join(r.choice(["alpha", "beta", "token = abcdef99", "the MIT License", "Ünï", "gnu general public license"]) for _ in range(4_000))
TEXTS = [(1, "password: hunter22 and CC-BY, cc by\nmail a@b.example.com"), (2, None), (3, ""), (4, LONG), (5, "x y z"), (5, "x y z"), (None, "null id"), (6, "GNU  General public LICENSE 日本 deadbeefdeadbeefdeadbeef")]
TEXTS += [(10 + i, " ".join(r.choice(["good", "fine", "vile", "a", "b"][: 3 if i % 2 else 5]) for _ in range(12))) for i in range(40)]
VECTORS = [(i, [r.gauss(0, 1) for _ in range(8)], i % 2) for i in range(30)]
VECTORS += [(100, VECTORS[3][1], 1), (103, VECTORS[3][1], 1), (101, None, 0), (102, VECTORS[4][1], None)]
PAGES = [(1, "u", "<p>"), (2, "v", "<p>"), (3, None, None), (4, "w", ""), (5, "x", "<b>" * 20_000)]
TALKS = [(1, 0, "user", "a <|end|> b"), (1, 1, "assistant", None), (2, 0, "assistant", "~1 <|text|>"), (2, 1, "user", "x" * 60_000)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = []
    for full in (True, False):
        d = str(tmp_path_factory.mktemp("tables"))
        some = lambda rows: rows if full else []  # noqa: B023, E731
        docs = spark.createDataFrame(some([(i, t, "en" if k % 3 else None, "s", len(t or "")) for k, (i, t) in enumerate(TEXTS)]), DOCUMENTS)
        docs.withColumns({c: F.lit("clash") for c in CLASHES}).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(some([(i, 1, int("vile" in (t or ""))) for i, t in TEXTS]), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(some([(1, "x y"), (2, None), (3, TEXTS[0][1])]), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame(some(VECTORS), "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
        spark.createDataFrame(some(PAGES), "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).write.parquet(f"{d}/pages.parquet")
        spark.createDataFrame(some(TALKS), "conv_id long, turn int, role string, text string").withColumn("nth", F.lit(1)).write.parquet(f"{d}/conversations.parquet")
        out.append(d)
    return out


def run(spark, name, folder):
    return sorted((x.asDict() for x in queries.QUERIES[name](spark, folder).collect()), key=lambda x: str(sorted(x.items(), key=str)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    assert len(run(spark, name, folders[1])) == (1 if name == "op9_chat" else 0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, folders, name):
    c = duckdb.connect()
    for t in ("embeddings", "pages", "conversations", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folders[0]}/{t}.parquet/*.parquet'")
    got = run(spark, name, folders[0])
    made = c.execute(queries.SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(map(str, (tuple(x[n] for n in names) for x in got))) == sorted(map(str, made.fetchall())) and got


def test_packing(spark, folders):
    rows = run(spark, "op1_pack", folders[0])
    assert all(x["length"] <= 2048 and x["offset"] + x["length"] <= 2048 for x in rows)
    assert sorted({x["doc_id"] for x in rows}, key=str) == sorted({i for i, _ in TEXTS}, key=str)
    long = sorted((x for x in rows if x["doc_id"] == 4), key=lambda x: x["piece"])
    assert len(long) > 5 and [x["start"] for x in long] == [sum(y["length"] for y in long[:k]) for k in range(len(long))]


def test_licenses(spark, folders):
    made = {x["doc_id"]: x for x in run(spark, "op2_licenses", folders[0])}
    for i, t in TEXTS:
        words = WORD.findall(low(t))
        at = {p: [a for a in range(len(words)) if words[a : a + len(p.split())] == p.split()] for p in licenses.PHRASES}
        places = [a for x in at.values() for a in x]
        x = made[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert x["base_labels"] == ",".join(sorted(licenses.PHRASES[p] for p, a in at.items() if a)) and 0 <= x["score"] <= 1
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(","))


def test_suppression(spark):
    rows = [(k, [(s, s + r.randrange(1, 9), i, r.randrange(1, 4), 1.0, f"l{i}") for i in range(r.randrange(14)) for s in [r.randrange(12)]]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, found array<struct<start:int,end:int,rule:int,priority:int,weight:double,label:string>>")
    for x in df.select("k", licenses._unsuppressed(F.col("found")).alias("left")).collect():
        found = rows[x["k"]][1]
        # what lies inside another of the same or a higher priority goes; of equal ones the higher priority, then the first rule stays
        holds = lambda a, b: a[0] <= b[0] and b[1] <= a[1] and a[3] >= b[3] and (a[:2] != b[:2] or a[3] > b[3] or a[2] < b[2])
        assert sorted((y["start"], y["end"], y["label"]) for y in x["left"]) == sorted((b[0], b[1], b[5]) for b in found if not any(holds(a, b) for a in found if a is not b))


def test_secrets(spark, folders):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    made = {x["doc_id"]: x for x in run(spark, "op4_secrets", folders[0])}
    for i, t in TEXTS:
        found = sorted((m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(kinds) for m in p.finditer(t or "") if good(m))
        assert made[i]["base_sha256"] == hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in found).encode()).hexdigest()
        assert [made[i][f"n_{n}"] for n, *_ in kinds] == [sum(x[3] == n for x in found) for n, *_ in kinds]


def test_other_secrets_against_whole_text_search():
    head = "eyJhbGciOiJub25lIn0"
    pool = [head, ".", "eyJ", "e30", "eyJhIjoxfQ", "sk_live_" + "a1" * 12, "AIza" + "b" * 35, "xoxb-123456-abcdef", " ", "-----BEGIN PRIVATE KEY-----", "MAMCAQA=", "-----END PRIVATE KEY-----", "\n", "ghp_" + "a" * 36, "é", "[" * 40]
    for _ in range(3000):
        t = "".join(r.choices(pool, k=r.randrange(9))).encode()
        got = secrets.spans(t)
        for k, kind in enumerate(secrets.KINDS):
            if kind.name in ("jwt", "slack", "google", "stripe", "pem", "github"):
                assert [(s, e) for s, n, e in got if n == k] == [m.span() for m in kind.pattern.finditer(t) if kind.valid(m)], (kind.name, t)
    assert secrets.spans(b"eyJ" + b"W1tb" * 50_000 + b".eyJh.x") == [] and secrets.spans(b"eyJ" * 100_000) == []


def test_decontamination(spark, folders):
    made = run(spark, "op5_decontaminate", folders[0])
    assert len(made) == len(TEXTS) and {x["doc_id"] for x in made if x["contaminated"]} == {1, 5}


def test_toxicity(spark, folders):
    made = run(spark, "op7_toxicity", folders[0])
    assert len(made) == len(TEXTS)
    for x in made:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) and x["flagged"] == (x["score"] >= x["threshold"])


def test_simhash(spark, folders):
    made = {x["doc_id"]: x for x in run(spark, "op8_simhash", folders[0])}
    assert made[2]["fingerprint"] == made[3]["fingerprint"] == "0" * 16 and made[3]["component_id"] == 2
    assert all(re.fullmatch("[0-9a-f]{16}", x["fingerprint"]) for x in made.values())


def test_pii(spark, folders):
    made = {x["doc_id"]: x for x in run(spark, "op10_pii", folders[0])}
    assert made[1]["n_email"] == 1 and "a@b." not in made[1]["text"] and made[2]["text"] is None and made[4]["text"] == LONG


def test_bad_headers_are_findings():
    from storyproof.llm import warc

    good = warc.build(7, "u", b"x", hashlib.sha1(b"x").hexdigest(), 1)
    for old, new in ((b"X-Page-ID: 7", b"X-Page-ID: abc"), (b"X-Page-ID: 7", b"X-Page-ID: " + b"9" * 30), (b"\r\nContent-Length: ", "\r\nContent-Length: ²".encode()), (b"WARC-Type: response", b"WARC-Type: x")):
        with pytest.raises(warc.Damaged):
            warc.parse(good.replace(old, new))
    assert warc.parse(good)["page_id"] == 7
    again = warc.build(8, "u", b"x", hashlib.sha1(b"x").hexdigest(), 1, (7, "u", True))
    assert warc.record_id(7, hashlib.sha1(b"x").hexdigest()).encode() in again and warc.parse(again)["refers_to"] == 7
