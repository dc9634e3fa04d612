"""A whole run over two tiny novels, its files, and the stream."""

import dataclasses
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from storyproof.config import Chunking, Retrieval, Settings, Verifier
from storyproof.operators import conflicts, measures, retrieval, verify
from storyproof.plans import evaluation, pipeline
from storyproof.sources import readers, writers
from storyproof.sources.paths import Files
from storyproof.streaming import asof, segments

CFG = dataclasses.replace(Settings(), chunking=Chunking(12, 3, 3))


def inputs(d):
    (d / "Castaways of Time.txt").write_text("Preface\nChapter 1\nJohn Grant was born in Paris. Later he lived in London.\nChapter 2\nJohn Grant never lived in London.\n")
    (d / "Monte.txt").write_bytes("Chapter 1\r\nEdmond married Mercédès in the old church.\n".encode("latin-1"))
    (d / "train.csv").write_text('id,book_name,char,content,label\n1,castaways of time,John Grant,"Born in Paris, he lived in London.",consistent\n2,Monte,Edmond,Edmond never married Mercédès in the old church.,contradict\n')
    (d / "test.csv").write_text('id,book_name,char,content\n3,MONTE,Edmond,"He married Mercédès in the old church; and ""so"" he stayed there"\n4,Unknown,X,\n')
    return [str(d / n) for n in ("train.csv", "test.csv")], [str(d / n) for n in ("Castaways of Time.txt", "Monte.txt")]


def test_run(spark, tmp_path):
    (train, test), novels = inputs(tmp_path)
    paths = pipeline.execute(spark, train, test, novels, str(tmp_path / "out"), CFG, "r1")
    results = {r["id"]: r["prediction"] for r in spark.read.csv(paths["results"], header=True, inferSchema=True).collect()}
    assert set(results) == {3, 4} and results[4] == 0
    with zipfile.ZipFile(paths["package"]) as z:
        assert "run_manifest.json" in z.namelist() and any(n.startswith("results/") for n in z.namelist())
    text = (tmp_path / "out/gold/run_id=r1/dossier/3.md").read_text()
    assert "**claim:** Edmond married Mercédès in the old church." in text and "| SUPPORT |" in text
    registry = {r["book_name"]: r["encoding"] for r in spark.read.parquet(str(tmp_path / "out/silver/novel_registry")).collect()}
    assert registry == {"Castaways of Time": "utf-8", "Monte": "latin-1"}
    assert (tmp_path / "out/bronze/novels/Monte.txt").exists()
    told = evaluation.evaluate(spark, train, str(tmp_path / "out"), "r1")
    metrics = json.loads(open(told["metrics"]).read())
    assert metrics["n_eval"] == 2 and metrics["source"] == "gold_decision_scores" and 0 <= metrics["accuracy"] <= 1
    assert "Train Evaluation" in open(told["run_report"]).read()
    # a later step starts from stored tables
    chunks = spark.read.parquet(str(tmp_path / "out/silver/chunks")).where(F.col("run_id") == "r1")
    assert {r["chapter_id"] for r in chunks.collect()} == {"ch001", "ch002"}
    assert measures.accuracy(spark.createDataFrame([(1, 1), (0, 1)], "y int, p int")).first()["accuracy"] == 0.5


def test_nothing_found(spark):
    train = spark.createDataFrame([(1, "b", "X", None, "", "consistent")], "id long, book_name string, char string, caption string, content string, label string")
    novels = spark.createDataFrame([("b", "")], "book_name string, text string")
    run = pipeline.plan(train, train.drop("label").limit(0), novels, CFG)
    assert run.evidence.count() == 0 and [tuple(r) for r in run.decisions.select("id", "prediction", "status").collect()] == [(1, 0, "SAT")]


def test_a_model_judges_statements(spark):
    judge = verify.ModelJudge("toy", lambda: lambda p, h: [(0.95, 0.01, 0.04) if set(y.split()) <= set(x.split()) else (0.02, 0.9, 0.08) for x, y in zip(p, h, strict=True)])
    stated = spark.createDataFrame([(1, i, f"t{i}", t, 0.8) for i, t in enumerate(["John sailed south alone", "John sailed south", "John sailed south never alone again"])], "id long, pos int, triple_id string, text string, confidence double")
    pairs = conflicts.candidate_pairs(stated)
    found = conflicts.by_model(pairs, conflicts.judged(pairs, stated, judge), stated).select("violation.*").collect()
    assert (("t0", "t1"), "SOFT") in {(tuple(r["supporting_triples"]), r["severity"]) for r in found}
    assert isinstance(verify.judge_of(Verifier()), verify.LexicalJudge)
    with pytest.warns(UserWarning, match="tokens"):
        assert isinstance(verify.judge_of(Verifier(backend="mnli:none")), verify.LexicalJudge)
    with pytest.raises(ValueError, match="unknown verifier"):
        verify.judge_of(Verifier(backend="oracle"))


def test_readers(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('id,book_name,extra\n1,"a, ""b""\nc",9\nx,,8\n')
    rows = readers.csv(spark, str(p), "id long, book_name string, caption string").collect()
    assert [tuple(r) for r in rows] == [(1, 'a, "b"\nc', None), (None, None, None)]
    (tmp_path / "g.jsonl").write_text('{"claim_id": "1_c01", "label": "E"}\n\n')
    assert [tuple(r) for r in readers.gold_labels(spark, str(tmp_path / "g.jsonl")).collect()] == [("1_c01", "E")]
    path, df = readers.first_there(spark, [(str(tmp_path / "no.csv"), "a string"), (str(p), "id long")])
    assert path == str(p) and df.columns == ["id"]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("x", i, t, "c", "MID") for i, t in enumerate(["a b", "b c", "d"])], "corpus string, doc int, text string, chapter string, bucket string")
    asked = spark.createDataFrame([(1, "x", ["b"]), (2, "x", ["d"])], "query int, corpus string, terms array<string>")
    asked.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).json(str(tmp_path / "in"))
    segments.append(spark, str(tmp_path / "index"), docs)
    failing = iter([True])

    def snapshot():
        if next(failing, False):
            raise OSError("gone")
        return segments.load(spark, str(tmp_path / "index"))

    q = asof.answer_stream(stream, snapshot, lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "cp"), Retrieval(k=1), fallback=lambda: retrieval.build(docs))
    q.awaitTermination(120)
    got = {r["query"]: r["doc"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 0, 2: 2}


def test_index_grows_between_batches(spark, tmp_path):
    """Chunks arrive between batches of claims; later answers see them, earlier ones stay, merging changes nothing."""
    from storyproof.__main__ import add, answer

    index, out, claims = (str(tmp_path / x) for x in ("index", "out", "claims"))

    def chunks(name, rows):
        made = spark.createDataFrame([("Book ", i, t, 0.1, "ch1", "EARLY") for i, t in rows], "book_name string, chunk_id string, chunk_text string, chunk_pos double, chapter_id string, time_bucket string")
        made.write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    def claim(n):
        spark.createDataFrame([(f"{n}_c1", "book", "the red fox", "", ["fox"], ["P(x)"])], "claim_id string, book_name string, claim_text string, char string, keywords array<string>, predicate_form array<string>").write.mode("append").json(claims)

    def answers():
        found = {}
        for r in spark.read.parquet(f"{out}/answers").orderBy("batch", "query", "rank").collect():
            found.setdefault((r["batch"], r["query"]), []).append(r["doc"])
        return found

    assert add(spark, chunks("a", [("c1", "a red hen"), ("c2", "nothing")]), index) == {"version": 1}
    claim(1)
    answer(spark, claims, index, out)
    assert answers() == {(0, "1_c1"): ["c1", "c2"]}
    assert add(spark, chunks("b", [("c3", "the red fox"), ("c4", "a fox")]), index) == {"version": 2}
    claim(2)
    answer(spark, claims, index, out)
    assert answers() == {(0, "1_c1"): ["c1", "c2"], (1, "2_c1"): ["c3", "c4", "c1", "c2"]}
    two = segments.load(spark, index, 2)
    whole = retrieval.build(two.docs.join(spark.createDataFrame([("c1", "a red hen"), ("c2", "nothing"), ("c3", "the red fox"), ("c4", "a fox")], "doc string, text string"), "doc"))
    sorted_rows = lambda df: sorted(map(tuple, df.collect()))
    assert sorted_rows(two.weights()) == sorted_rows(whole.weights()) and sorted_rows(two.postings) == sorted_rows(whole.postings)
    assert segments.merge(spark, index) == 3 and sorted_rows(segments.load(spark, index).weights()) == sorted_rows(whole.weights())
    assert segments.load(spark, index, 1).docs.count() == 2
    assert len(segments.vacuum(spark, index, 1)) == 2 and segments.versions(spark, index) == [3] and segments.load(spark, index).docs.count() == 4
    claim(3)
    answer(spark, claims, index, out)
    assert answers()[2, "3_c1"] == ["c3", "c4", "c1", "c2"]
    with pytest.raises(FileNotFoundError):
        segments.load(spark, index, 1)


def test_run_with_uris(spark, tmp_path):
    """Inputs and outputs by URIs, in a folder whose name has a space; the package is made by the executors."""
    (tmp_path / "in put").mkdir()
    (train, test), novels = inputs(tmp_path / "in put")
    out = f"file://{tmp_path}/out put"
    paths = pipeline.execute(spark, f"file://{train}", f"file://{test}", [f"file://{n}" for n in novels], out + "/", CFG, "r2")
    assert all(p.startswith(out) for p in paths.values())
    local = lambda p: p.removeprefix("file://")
    with zipfile.ZipFile(local(paths["package"])) as z:
        assert z.testzip() is None and {"run_manifest.json", "dossier_r2.zip", "report_r2.md"} < set(z.namelist())
        assert not [n for n in z.namelist() if n.split("/")[-1][0] in "._"]
        manifest = json.loads(z.read("run_manifest.json"))
    assert manifest["inputs"][f"file://{train}"] == hashlib.sha256(open(train, "rb").read()).hexdigest()
    with zipfile.ZipFile(local(paths["dossiers"])) as z:
        assert z.namelist() and all(z.read(n) == open(f"{local(out)}/gold/run_id=r2/{n}", "rb").read() for n in z.namelist())
    store = Files(spark)
    assert store.read(paths["report"]).startswith("# Run Report") and store.names(out + "/nowhere") == []
    told = evaluation.evaluate(spark, f"file://{train}", out)
    assert told["run_report"].startswith(out) and "Train Evaluation" in store.read(told["run_report"])
    # the index of the run is there for streams of claims
    assert segments.versions(spark, f"{out}/silver/index/run_id=r2") == [1]
    empty = writers.zipped(spark, f"{out}/empty.zip", {"nothing": f"{out}/nowhere"})
    with zipfile.ZipFile(local(empty)) as z:
        assert z.namelist() == []
