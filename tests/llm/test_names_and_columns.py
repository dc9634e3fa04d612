"""PII of any length and with composed names, stages over columns of any name and empty tables, and other mended cases."""

import hashlib
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storyproof.llm import decontaminate, embeddings, pii, warc
from storyproof.sources import store

r = random.Random(5)
ODD = ["a.b", "a`b", "x y", "UID", "score", "kept_0", "c0", "spans"]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 128, 3_500, 10_000, 60_000])
def test_long_entities(size):
    for text, kind in ((f"mail {'ab1.' * size}x@example.com now", "email"), (f"Dr X{'ab' * size} came", "person")):
        made, found = pii.replaced(text, text.encode(), "v0")
        assert [e["kind"] for e in found] == [kind] and len(made) == len(text) and found[0]["original"] != found[0]["surrogate"]
        assert (made, found) == pii.replaced(text, text.encode(), "v0") and made != pii.replaced(text, text.encode(), "v1")[0]
        again, old = [x[found[0]["start"] : found[0]["end"]] for x in (made, text)]
        assert [c.isalpha() for c in again] == [c.isalpha() for c in old]


def test_blocks_are_one_to_one():
    made = {pii.shuffled(f"{'z' * 63}{a}{b}{'q' * 70}", "t") for a in "bcdfg" for b in "bcdfg"}
    assert len(made) == 25 and len({x[:64] for x in made}) == 5 and all(x[65:] != "q" * 70 for x in made)


@pytest.mark.parametrize("text", ["Mr. Jean-Luc Picard", "Mr O'Brien", "Mr O’Brien", "M. Dupont", "Mr de Gaulle", "Mme Marie van der Berg", "Anna Müller-Lüdenscheidt", "Mr d'Artagnan", "Frau Dr Ada Lovelace"])
def test_composed_names(text):
    made, found = pii.replaced(f"Then {text} left.", f"Then {text} left.".encode(), "v0")
    old = set(pii.re.findall(r"[^\W\d_]{2,}", text)) - set(pii.PARTICLES) - set(pii._TITLE_GENDER)
    assert len(found) == 1 and not old & set(pii.re.findall(r"[^\W\d_]{2,}", made)), made
    keep = lambda t: pii.re.sub(r"[^\W\d_]+", lambda m: m[0] if m[0] in pii.PARTICLES or m[0] in pii._TITLE_GENDER else "w", t)
    assert keep(made) == keep(f"Then {text} left.".replace("Then", "x").replace("left", "x"))


def test_mentions_of_a_surname():
    text = "Picard sat. Mme Dupont met Mr Jean-Luc Picard; M. Dupont and Picard's Picardie, Dupont-Picard, dupont, Dupont."
    made, found = pii.replaced(text, text.encode(), "v0")
    picard, dupont = pii._family("Picard", "v0"), pii._family("Dupont", "v0")
    assert made.startswith(f"{picard} sat. Mme {dupont} met Mr ") and made.endswith(f" {picard}; M. {dupont} and {picard}'s Picardie, Dupont-Picard, dupont, {dupont}.")
    assert len(found) == 6 and all(text[:0] == "" and e["kind"] == "person" for e in found)
    of = {made[e["start"] : e["end"]]: e["original"] for e in found}
    assert of[picard] == found[-3]["original"] or picard in of


def test_replacement_against_single_entities(spark):
    """Whole texts against a plain version that knows where it put the entities and replaces each of them alone."""
    pool = ["a@b.example.com", "Dr. Ada Lovelace", "Mr O'Neil", "+49 170 1234567", "10.2.3.4", "123-45-6789", "4111 1111 1111 1111", "DE89370400440532013000", "Анна Петрова", "M. de Vries", "x" * 5_000 + "@example.org"]
    words = ["lorem", "ipsum", "a.b", "日本", "42", "(see", "below)"]
    rows, want = [], {}
    tweak = pii.secret_tweak(b"k")
    for i in range(60):
        parts = [r.choice(pool) if r.random() < 0.3 else r.choice(words) for _ in range(r.randrange(1, 25))]
        alone = {p: pii.replaced(p, p.encode(), tweak)[0] for p in pool}
        rows.append((i, " ; ".join(parts)))
        want[i] = " ; ".join(alone.get(p, p) for p in parts)
    got = {x["doc_id"]: x["text"] for x in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert got == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    texts = [" ".join(r.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(40)]
    benchmark = " ".join(f"b{i}" for i in range(30))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(100, texts[0], "en", "s", 1), (101, texts[1] + " " + benchmark, "en", "s", 1), (102, "password = hunter2hunter2", "en", "s", 1), (103, None, None, None, None), (None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *(F.lit(f"of {c}").alias(c) for c in ODD)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("i", benchmark)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, folder, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.read.parquet(f"{folder}/documents.parquet")
    made = stage(spark, docs, folder)
    rows = made.collect()
    assert stage(spark, docs.limit(0), folder).count() == 0
    if name == "packing":
        return
    assert made.schema.names == docs.schema.names and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
    assert all(tuple(x)[5:] == tuple(f"of {c}" for c in ODD) for x in rows)
    ids = {x["doc_id"] for x in rows}
    if name == "simhash":
        # the texts without words are one group; a row without doc_id stays besides
        assert ids == {*range(40), 101, 102, 103, None}
    if name == "decontamination":
        assert ids == {*range(40), 100, 102, 103, None}
    if name == "secrets":
        assert len(rows) == docs.count() and next(x["text"] for x in rows if x["doc_id"] == 102) == "[assign]"


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_matches_of_a_shared_window(spark, monkeypatch):
    """A near match of a window that many items share is one match, however the items are dealt into rows."""
    words = [f"a{i}" for i in range(1, 13)]
    df = spark.createDataFrame([(1, " ".join(words[:4] + ["zz"] + words[5:])), (2, " ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k}", " ".join(words)) for k in range(9)], "item_id string, text string")
    found = []
    for items in (10_000, 2):
        monkeypatch.setattr(decontaminate, "ITEMS", items)
        found.append([(x["doc_id"], x["n_near"], sorted(map(tuple, x["near"])), x["items"]) for x in decontaminate.contamination(df, bench).orderBy("doc_id").collect()])
    assert found[0] == found[1] and found[0][1][3] == sorted(f"i{k}" for k in range(9)) and found[0][0][1] > 0


def test_vectors_of_any_scale(spark):
    """Squares of components may leave the range of double precision; components may not."""
    base = [[1.0, 2.0, -1.0], [1.0, 2.0, -1.01], [3.0, -1.0, 0.5]]
    rows, scales = [], (1.0, 1e200, 1e-200, 1e300, 5e-324)
    for k, scale in enumerate(scales):
        rows += [(10 * k + i, [x * scale for x in v], 7) for i, v in enumerate(base)]
    rows += [(900, [0.0, -0.0, 0.0], 7), (901, [float("inf"), 1.0, 1.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    scaled = [np.array(v) / np.abs(v).max() for _, v, _ in rows[:-2]]
    want = {i: sum(float(x @ y / np.sqrt((x @ x) * (y @ y))) >= 0.98 for m, y in enumerate(scaled) if m != k) for k, ((i, _, _), x) in enumerate(zip(rows, scaled, strict=False))} | {900: 0, 901: 0}
    made = {x["vec_id"]: x["n_links"] for x in embeddings.near_duplicates(df).collect()}
    assert made == want and made[0] >= 7


def test_archives_go_with_the_session(spark):
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "v", "<p>")], "page_id long, url string, html string")
    folder, manifest = warc.write(pages)
    assert folder in store._written and warc.read(manifest).count() == 2
    kept = dict(store._written)
    path = pathlib.Path(folder.removeprefix("file://"))
    assert any(path.iterdir())
    store.remove(folder)
    assert not path.exists() and set(kept) - set(store._written) == {folder}


@pytest.mark.parametrize(("old", "new"), [("WARC-Date: 2000-01-01T00:00:00Z", "WARC-Date: 2000-13-01T00:00:00Z"), ("WARC-Date: 2000-01-01T00:00:00Z", "WARC-Date: yesterday"), ("WARC-Date: 2000-01-01T00:00:00Z", "WARC-Date: 2000-01-01T00:00:00"), ("<urn:uuid:", "<urn:x:"), ("WARC-Refers-To: <urn:uuid:", "WARC-Refers-To: urn:uuid:")])
def test_dates_and_ids_of_records(old, new):
    sha1 = hashlib.sha1(b"x").hexdigest()
    good = warc.build(8, "u", b"x", sha1, 1, (7, "u", True))
    assert warc.parse(good) and old.encode() in good and warc.parse(good.replace(b"WARC-Date: 2000-01-01T00:00:00Z", b"WARC-Date: 2000-01-01T00:00:00.25Z"))
    with pytest.raises(warc.Damaged):
        warc.parse(good.replace(old.encode(), new.encode()))
