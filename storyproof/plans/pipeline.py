"""From novels and summaries of characters to decisions, reports and a package: DataFrame steps over stored tables, then sinks."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof import schemas
from storyproof.config import Settings, load
from storyproof.functions import text as T
from storyproof.operators import chunking, conflicts, decide, graph, long_texts, report, retrieval, statements, verify
from storyproof.sources import readers, writers
from storyproof.sources.paths import Files
from storyproof.streaming import segments


@dataclass
class Run:
    """The tables of a run."""

    novels: DataFrame
    chunks: DataFrame
    claims: DataFrame
    candidates: DataFrame
    coverage: DataFrame
    evidence: DataFrame
    facts: DataFrame
    aliases: DataFrame
    triples: DataFrame
    constraints: DataFrame
    grounded: DataFrame
    threshold: DataFrame
    decisions: DataFrame
    dossiers: DataFrame


def checkpointed(name: str, df: DataFrame) -> DataFrame:
    """A table that later steps read, stored in the session's spark.checkpoint.dir, so that plans stay short."""
    return df.checkpoint()


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as the documents of an index; books are matched by trimmed, lower-cased name."""
    return chunks.select(_key().alias("corpus"), F.col("chunk_id").alias("doc"), F.col("chunk_text").alias("text"), F.col("chapter_id").alias("chapter"), F.col("time_bucket").alias("bucket"), "chunk_pos", F.col("book_name").alias("title"))


def query_rows(claims: DataFrame) -> DataFrame:
    """Claims as queries of their book's index."""
    return claims.select(F.col("claim_id").alias("query"), _key().alias("corpus"), retrieval.query_terms(claims).alias("terms"))


def _key() -> Column:
    return F.lower(F.trim("book_name"))


def retrieved(claims: DataFrame, chunks: DataFrame, cfg: Settings, run_id: str, indexed: Callable[[DataFrame], retrieval.Index] = retrieval.build) -> tuple[DataFrame, DataFrame]:
    """Candidates and coverage of claims, from the index that indexed makes of the chunks."""
    queries = query_rows(claims)
    best = retrieval.top_k(retrieval.pool(indexed(index_rows(chunks)), queries, cfg.retrieval, ("chapter", "bucket", "chunk_pos", "title")), cfg.retrieval)
    ids = claims.select("id", F.col("claim_id").alias("query"), "split", F.col("book_name").alias("_asked"))
    found = best.join(ids, "query").orderBy("query", "rank").select(
        "id", F.col("query").alias("claim_id"), F.col("title").alias("book_name"), F.col("doc").alias("chunk_id"), F.col("chapter").alias("chapter_id"), "chunk_pos", F.col("bucket").alias("time_bucket"), F.lit("bm25").alias("retrieval_stage"),
        F.lit(None).cast("double").alias("score_vec"), F.col("score").alias("score_lex"), F.lit(None).cast("double").alias("score_rerank"), F.col("score_norm").alias("score_lex_norm"), F.col("rank").cast("int").alias("rank"), F.lit(False).alias("is_disjoint"), F.lit(run_id).alias("run_id"),
    )
    covered = retrieval.coverage(queries, best).join(ids, "query").select(
        "id", F.col("query").alias("claim_id"), F.col("_asked").alias("book_name"), "k_found", "buckets_covered", "unique_chapters", "split", F.lit("bm25").alias("backend"), F.lit(cfg.retrieval.k).alias("K"),
        F.lit(cfg.retrieval.candidate_pool).alias("candidate_pool"), F.lit(cfg.retrieval.max_per_chapter).alias("max_per_chapter"), F.lit(cfg.retrieval.enforce_buckets).alias("enforce_buckets"), F.lit(run_id).alias("run_id"),
    )
    return found, covered


def after_facts(ids: DataFrame, claims: DataFrame, chunks: DataFrame, candidates: DataFrame, evidence: DataFrame, facts: DataFrame, train: DataFrame, cfg: Settings, run_id: str, keep: Callable[[str, DataFrame], DataFrame] = checkpointed, judge: verify.Judge | None = None) -> dict[str, DataFrame]:
    """The steps from facts on; any run can be taken up here from stored tables. A model as judge compares statements, too."""
    aliases = graph.alias_table(claims, run_id)
    triples = keep("triples", graph.triples(facts, chunks, evidence, aliases, cfg.kg.min_fact_conf, run_id))
    stated = conflicts.stated(triples)
    pairs = conflicts.candidate_pairs(stated, cfg.logic)
    if judge is None or isinstance(judge, verify.LexicalJudge):
        unlike = conflicts.lexical(pairs, stated, cfg.logic)
    else:
        pairs = keep("statement_pairs", pairs)
        unlike = conflicts.by_model(pairs, conflicts.judged(pairs, stated, judge, cfg.verifier.known), stated, cfg.logic)
    found = conflicts.structural(triples).unionByName(unlike)
    constraints = keep("constraints", conflicts.constraints(ids, found, triples, run_id))
    labels = train.select("id", T.truth(F.col("label")).alias("y")).where("y is not null")
    feats = decide.features(ids, evidence, constraints, labels, cfg.aggregation)
    threshold = decide.calibrated(feats.where("split = 'train'"), cfg.aggregation)
    decisions = keep("decisions", decide.decisions(feats, threshold, cfg.aggregation))
    return {"aliases": aliases, "triples": triples, "constraints": constraints, "grounded": conflicts.grounded(ids, run_id), "threshold": threshold, "decisions": decisions, "dossiers": report.dossiers(decisions, claims, evidence, candidates, chunks)}


def plan(train: DataFrame, test: DataFrame, novels: DataFrame, cfg: Settings | None = None, run_id: str = "run", judge: verify.Judge | None = None, keep: Callable[[str, DataFrame], DataFrame] = checkpointed, indexed: Callable[[DataFrame], retrieval.Index] = retrieval.build, chunks: DataFrame | None = None) -> Run:
    """All tables of a run of train and test rows over novels (book_name, text, position where their order counts).

    keep(name, df) gives back what later steps read in place of a table that several of them need; indexed makes the index.
    Where chunks are given, novels need no text.
    """
    cfg = cfg or Settings()
    judge = judge or verify.judge_of(cfg.verifier)
    titles = novels.select("book_name", "position" if "position" in novels.columns else F.col("book_name").alias("position"))
    chunks = keep("chunks", chunking.chunks(novels, cfg.chunking, run_id) if chunks is None else chunks)
    both = [statements.claims(statements.remap_titles(rows, titles), split, run_id) for rows, split in ((train, "train"), (test, "test"))]
    claims = keep("claims", both[0].unionByName(both[1]))
    candidates, covered = retrieved(claims, chunks, cfg, run_id, indexed)
    candidates = keep("candidates", candidates)
    evidence = keep("evidence", verify.evidence(candidates, claims, chunks, judge, cfg.verifier, run_id))
    facts = keep("facts", verify.facts(evidence, cfg.verifier))
    ids = train.select("id").union(test.select("id")).distinct()
    rest = after_facts(ids, claims, chunks, candidates, evidence, facts, train, cfg, run_id, keep, judge)
    kept = [c.split()[0] for c in schemas.EVIDENCE.split(", ")]
    return Run(novels=novels, chunks=chunks, claims=claims, candidates=candidates, coverage=covered, evidence=evidence.select(*kept), facts=facts, **rest)


def execute(spark: SparkSession, train: str, test: str, novel_paths: list[str], out: str, cfg: Settings | None = None, run_id: str | None = None) -> dict[str, str]:
    """A whole run with its files under out: tables, results, reports, manifest and package; gives the paths of the last.

    Inputs and out may be in any store that both Spark and the executors' Arrow know, such as file:, hdfs: or s3:.
    """
    cfg, run_id = cfg or load(), run_id or f"run_{datetime.now(UTC):%Y%m%d_%H%M%S}"
    train_df, test_df = readers.csv(spark, train, schemas.TRAIN), readers.csv(spark, test, schemas.TEST)
    store, out = Files(spark), out.rstrip("/")
    bronze, silver, gold = (f"{out}/{x}" for x in ("bronze", "silver", "gold"))
    late = ("constraints", "grounded", "decisions")

    def stored(name: str, df: DataFrame) -> DataFrame:
        """Writes a table into its partition of this run and reads that back; a step can be taken up from there."""
        path = f"{gold if name in late else silver}/{name}/run_id={run_id}"
        df.drop("run_id").write.mode("overwrite").parquet(path)
        return spark.read.schema(df.drop("run_id").schema).parquet(path).withColumn("run_id", F.lit(run_id))

    def indexed(rows: DataFrame) -> retrieval.Index:
        """Stores the index of this run, where streams of claims can be answered from it and chunks be added."""
        folder = f"{silver}/index/run_id={run_id}"
        return segments.load(spark, folder, segments.append(spark, folder, rows, replace=True))

    order = spark.createDataFrame([(PurePosixPath(p).stem, i) for i, p in enumerate(novel_paths)], "book_name string, position int").dropDuplicates(["book_name"])
    novels = long_texts.registry(spark, *novel_paths).join(order, "book_name", "left")
    run = plan(train_df, test_df, novels, cfg, run_id, keep=stored, indexed=indexed, chunks=long_texts.chunks(spark, novel_paths, cfg.chunking, run_id))
    writers.csv(train_df, f"{bronze}/train")
    writers.csv(test_df, f"{bronze}/test")
    for name in ("coverage", "aliases", "grounded"):
        stored(name, getattr(run, name))
    stored("novel_registry", run.novels.drop("position"))
    for p in novel_paths:
        store.copy(p, f"{bronze}/novels/{PurePosixPath(p).name}")
    decided, top = run.decisions, f"{gold}/run_id={run_id}"
    for name, rows in (("results", test_df), ("results_train", train_df)):
        writers.csv(decided.join(rows.select("id"), "id", "left_semi").select("id", "prediction").orderBy("id"), f"{top}/{name}")
    dossiers = writers.files(run.dossiers, store.uri(f"{top}/dossier"))
    written = dossiers.join(run.dossiers.select(F.col("id").cast("string").alias("name"), "id", "prediction", "split"), "name")
    writers.csv(written.select("id", "prediction", "split", F.col("path").alias("dossier_path")).orderBy("id"), f"{top}/dossier_index")
    dossier_zip = writers.zipped(spark, f"{top}/dossier_{run_id}.zip", {"dossier": f"{top}/dossier"})
    inputs = long_texts.digests_of(spark, train, test, *novel_paths)
    threshold = run.threshold.first()[0]
    manifest = writers.manifest(store, f"{out}/run_manifests/{run_id}.json", {"run_id": run_id, "inputs": inputs, "config": dataclasses.asdict(cfg), "outputs": {"threshold": threshold, "results": f"{top}/results"}})
    told = store.write(f"{top}/report_{run_id}.md", writers.run_report(run_id, store.exists(dossier_zip)))
    package = writers.zipped(spark, f"{top}/submission_{run_id}.zip", {"results": f"{top}/results", "run_manifest.json": manifest, PurePosixPath(dossier_zip).name: dossier_zip, PurePosixPath(told).name: told})
    return {"results": f"{top}/results", "manifest": manifest, "report": told, "dossiers": dossier_zip, "package": package}
