"""Statement pairs in tiles, exact quantiles, texts within texts, anchors and the order of claims, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyproof.config import Logic, Retrieval
from storyproof.functions import lexicon, normal
from storyproof.operators import conflicts, decide, graph, report, retrieval, statements, verify

r = random.Random(21)


def tokens(text):
    return set(re.findall("[a-z0-9']+", text.lower())) - set(lexicon.SET_STOPWORDS)


def brute_pairs(rows, cfg):
    for key in sorted({i for i, _, _ in rows if i is not None}):
        mine = sorted((pos, tokens(t)) for i, pos, t in rows if i == key and pos is not None)
        found = []
        for a, (i, x) in enumerate(mine):
            for j, y in mine[a + 1 :]:
                shared = len(x & y)
                if i < j and shared >= max(1, cfg.min_shared_tokens):
                    jac = shared / len(x | y)
                    unlike = bool(x & set(lexicon.SET_NEGATIONS)) != bool(y & set(lexicon.SET_NEGATIONS))
                    if jac >= cfg.min_jaccard or unlike and jac >= cfg.min_jaccard * 0.6:
                        found.append((key, i, j, shared, jac, unlike))
        yield from sorted(found, key=lambda p: (-p[3], p[1], p[2]))[: cfg.max_pairs]


@pytest.mark.parametrize("tile", [1000, 7, 40])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_in_tiles(spark, monkeypatch, tile, kind):
    monkeypatch.setattr(conflicts, "TILE", tile)
    words = [f"w{i}" for i in range(25)] + ["not", "never", "the"]
    rows = [(1 if k % 3 else 2, k, " ".join(r.choices(words, k=r.randrange(0, 14)))) for k in range(120)] + [(3, 1, "a b"), (None, 5, "w1 w2 w3"), (2, None, "w1 w2 w3"), (4, 9, "")]
    if kind == "string":
        rows = [(i, None if p is None else f"t{p}", t) for i, p, t in rows]
    for cfg in (Logic(), Logic(max_pairs=9, min_shared_tokens=1)):
        got = conflicts.candidate_pairs(spark.createDataFrame(rows, f"id long, pos {kind}, text string").repartition(4), cfg).collect()
        assert sorted(map(tuple, got)) == sorted(brute_pairs(rows, cfg))
    assert conflicts.candidate_pairs(spark.createDataFrame(rows, f"id long, pos {kind}, text string").limit(0)).count() == 0


def test_quantiles(spark):
    for values in ([], [1.5], [2.0, 2.0, 2.0], [r.choice([0.5, 1.0, -3.0, 7.25]) for _ in range(50)], [r.gauss(0, 1) for _ in range(777)]):
        df = spark.createDataFrame([(x,) for x in [*values, None]], "x double").repartition(5)
        got = {q["share"]: q["value"] for q in decide.quantiles(df, "x", decide.QUANTILES).collect()}
        assert set(got) == (set(decide.QUANTILES) if values else set())
        assert [got[q] for q in got] == pytest.approx([np.quantile(values, q) for q in got], abs=1e-12)
        plan = decide.thresholds(df.withColumnRenamed("x", "evidence_score"))._jdf.queryExecution().toString()
        assert "percentile" not in plan.lower()


def test_texts_within_texts(spark):
    some = lambda k: "".join(r.choices("abc日", k=k))
    inner = [some(r.randrange(1, 8)) for _ in range(80)] + ["zzzzzz", "z"]
    outer = [some(r.randrange(1, 30)) for _ in range(60)]
    got = statements.contained(spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string"))
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a in inner for b in outer if a in b})
    rows = spark.createDataFrame([("The Count of Monte Cristo (abridged)",), ("cristo",), ("castaways",), ("!",), (None,), ("nothing",)], "book_name string")
    titles = spark.createDataFrame([("The Count of Monte Cristo", 2), ("Monte Cristo", 1), ("In Search of the Castaways", 0), ("--", 3)], "book_name string, position int")
    made = statements.remap_titles(rows, titles)
    assert {x["raw_book_name"]: x["book_name"] for x in made.collect()} == {"The Count of Monte Cristo (abridged)": "Monte Cristo", "cristo": "Monte Cristo", "castaways": "In Search of the Castaways", "!": "!", None: None, "nothing": "nothing"}
    assert "NestedLoop" not in made._jdf.queryExecution().toString()


def test_anchors_begin_words(spark):
    texts = ["the authors' own", "un author", "coauthor", "don't go", "don't", "dogs' home", "日author x", "", "authority, reasonable"]
    anchors = ["author", "don't", "reason", "dogs'", "own"]
    df = spark.createDataFrame([(t, a) for t in texts for a in anchors], "t string, a string").withColumn("w", F.concat(F.lit(" "), F.regexp_replace("t", r"(?U)\W+", " ")))
    for x in df.select("*", normal.begins(F.col("t"), F.col("w"))(F.col("a")).alias("hit")).collect():
        assert x["hit"] == bool(re.search(rf"\b{re.escape(x['a'])}\w*\b", x["t"])), x


def test_order_of_claims(spark):
    schema = "id long, book_name string, char string, caption string, claim_id string, claim_text string, char_aliases array<string>, predicate_form array<string>, split string, row long"
    rows = [(1, "b", "Late", None, "1_c100", "x", ["Late"], [], "train", 99), (1, "b", "First", None, "1_c11", "zz first", ["First"], [], "train", 10), (1, "b", "Other", None, "1_c11", "aa last", ["Other"], [], "train", 11)]
    claims = spark.createDataFrame(rows, schema).repartition(3)
    chunks = spark.createDataFrame([("k", "aa last thing. Zz first.")], "chunk_id string, chunk_text string")
    candidates = spark.createDataFrame([(1, "1_c11", "b", "k", 1.0)], "id long, claim_id string, book_name string, chunk_id string, score_lex_norm double")
    assert [x["claim_text"] for x in verify.evidence(candidates, claims, chunks).collect()] == ["aa last"]
    for some in (claims, claims.drop("row")):
        assert [x["char"] for x in graph.characters(some.where("claim_id <> '1_c11' or char = 'First'")).collect()] == ["First"]


def test_dossiers_of_what_has_no_score(spark):
    """An excerpt keeps its letters where rank and score are missing."""
    decisions = spark.createDataFrame([(1, "train", 1, "SAT", "why")], "id long, split string, prediction int, status string, rationale string")
    claims = spark.createDataFrame([(1, "b", "Al", None, "1_c01", "the nullified vow", "UNK", "UNK", ["vow"], "train", 0)], "id long, book_name string, char string, caption string, claim_id string, claim_text string, claim_type string, t_hint string, keywords array<string>, split string, row long")
    evidence = spark.createDataFrame([(1, "1_c01", "k", "SUPPORT", 0.5)], "id long, claim_id string, chunk_id string, label string, confidence double")
    candidates = spark.createDataFrame([], "id long, claim_id string, chunk_id string, rank int, score_lex_norm double")
    chunks = spark.createDataFrame([("k", "ch", "MID", "Al annulled the vow; null and void.")], "chunk_id string, chapter_id string, time_bucket string, chunk_text string")
    (made,) = report.dossiers(decisions, claims, evidence, candidates, chunks).collect()
    assert "| SUPPORT | 0.500 |  |  | `k` | ch | MID | Al annulled the vow; null and void. |" in made["markdown"]


@pytest.mark.parametrize("block", [2048, 3])
def test_blocks_give_the_same_answers(spark, monkeypatch, block):
    """Best of blocks against all scores, with many blocks, slices of queries, ties at the last place and rare and common terms."""
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", block)
    monkeypatch.setattr(retrieval, "QUERIES_PER_TASK", 2 if block == 3 else 500)
    docs = [("x" if i % 4 else "y", f"d{i:03d}", " ".join(r.choices(["a", "b", "c", "the", f"r{i % 9}"], k=r.randrange(0, 20)))) for i in range(90)] + [("x", f"t{i}", "a b") for i in range(20)]
    index = retrieval.build(spark.createDataFrame(docs, "corpus string, doc string, text string").repartition(3).withColumns({"chapter": F.lit("c"), "bucket": F.lit("MID")}))
    asked = spark.createDataFrame([(q, c, t) for q, t in enumerate([["a"], ["the", "a", "b"], ["r1", "the"], ["zzz"], []]) for c in ("x", "y", "w")], "query long, corpus string, terms array<string>")
    cfg = Retrieval(candidate_pool=5)
    every = {}
    for x in retrieval.scores(index, asked, cfg).collect():
        every.setdefault((x["query"], x["corpus"]), []).append((-x["score"], x["doc"]))
    got = {}
    for x in retrieval.best(index, asked, cfg).collect():
        got.setdefault((x["query"], x["corpus"]), []).append((-x["score"], x["doc"]))
    assert {k: sorted(v)[:5] for k, v in got.items()} == {k: sorted(v)[:5] for k, v in every.items()}
    if block == 3:
        assert index.sizes.count() > 25


def test_scores_are_added_up_within_blocks(spark):
    """No shuffle by document: after the postings of a block have met its queries, nothing is exchanged."""
    index = retrieval.build(spark.createDataFrame([("x", "d1", "a b"), ("x", "d2", "a"), ("x", None, "b b")], "corpus string, doc string, text string"))
    found = retrieval.scores(index, spark.createDataFrame([(1, "x", ["a", "b"])], "query long, corpus string, terms array<string>"))
    assert sorted((x["doc"] or "") for x in found.collect()) == ["", "d1", "d2"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query" not in plan.split("CoGroup")[0] and "CoGroup" in plan


def test_passages_are_cut_into_words_once(spark):
    """Anchors and names of a passage are worked out below the explosion into sentences, not for each sentence."""
    rows = spark.createDataFrame([(1, "One a. Two b. Three c.", "Two b", ["two b"])], "k int, passage string, claim_text string, aliases array<string>")
    plan = verify.sentence_scores(rows, ["k"], 2)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode")
    assert "claim_text" not in above and "claim_text" in below


def test_a_model_is_asked_once_for_each_pair(spark, tmp_path):
    """Neither order nor repeats change the answers; a second run asks only for new pairs, in batches of like length."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def load():
        def predict(premises, hypotheses):
            import uuid

            (asked / uuid.uuid4().hex).write_text("\n".join(f"{p}|{h}" for p, h in zip(premises, hypotheses, strict=True)))
            return [(0.8, 0.1, 0.1) if h in p else (0.1, len(p) % 7 / 10, 0.3) for p, h in zip(premises, hypotheses, strict=True)]

        return predict

    judge = verify.ModelJudge("counting/toy", load)
    texts = ["a red fox", "a fox", "the sea " * 30, "", None]
    rows = [(k, r.choice(texts), r.choice(["fox", "sea", None])) for k in range(300)]
    schema = "k long, p string, h string"
    df = spark.createDataFrame(rows, schema).repartition(5)
    count = lambda: sorted(x for f in asked.iterdir() for x in f.read_text().split("\n"))
    plain = {x["k"]: x["j"] for x in df.select("k", judge(F.col("p"), F.col("h")).alias("j")).collect()}
    for f in asked.iterdir():
        f.unlink()
    distinct = sorted({f"{p or ''}|{h or ''}" for _, p, h in rows})
    for known in ("", str(tmp_path / "known"), str(tmp_path / "known")):
        got = {x["k"]: x["_j"] for x in verify.judged(df, judge, "p", "h", known).collect()}
        assert got == plain
    assert count() == sorted(distinct * 2)  # once without a folder, once with; the third time nothing
    more = spark.createDataFrame([*rows, (1000, "a new one", "fox")], schema)
    assert len(verify.judged(more, judge, "p", "h", str(tmp_path / "known")).collect()) == 301
    assert count() == sorted(distinct * 2 + ["a new one|fox"])
    assert verify.judged(more.limit(0), judge, "p", "h").count() == 0
