"""Orders, lines and documents as edges and statements of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.config import Logic
from storyproof.functions import lexicon
from storyproof.functions.text import mention_key
from storyproof.operators import conflicts, graph
from storyproof.plans.registry import query, quoted, table
from storyproof.sources.readers import spread

CFG = Logic()

EDGES = """edges AS (SELECT o_custkey AS id, 't_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS triple_id, CASE o_orderkey % 4 WHEN 0 THEN 'BornIn' WHEN 1 THEN 'MarriedTo' WHEN 2 THEN 'BornYear' ELSE 'Claim' END AS p,
  CAST(o_orderkey // 4 % 3 AS VARCHAR) AS o, 'POS' AS polarity, round(least(1.0::DOUBLE, o_totalprice / 399989.0::DOUBLE), 9) AS confidence FROM orders)"""
VIOLATIONS = (
    EDGES
    + """,
few AS (SELECT id, p, count(DISTINCT o) AS n, round(max(confidence), 4) AS c, list_sort(list(triple_id)) AS t FROM edges WHERE p <> 'Claim' GROUP BY ALL),
violations AS (SELECT id, CASE p WHEN 'MarriedTo' THEN 'MarriedTo(A,B) and MarriedTo(A,C) with B!=C (unless time-bucketed non-overlapping)' ELSE 'Unique' || p || '(A): cannot have multiple distinct ' || p || ' objects' END AS rule,
  t AS triples, c AS confidence, CASE p WHEN 'MarriedTo' THEN 'SOFT' ELSE 'HARD' END AS severity FROM few WHERE n >= 2)"""
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    p = F.when(key % 4 == 0, F.lit("BornIn")).when(key % 4 == 1, F.lit("MarriedTo")).when(key % 4 == 2, F.lit("BornYear")).otherwise(F.lit("Claim"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.concat(F.lit("t_"), F.lpad(key.cast("string"), 9, "0")).alias("triple_id"), p.alias("p"), F.expr("cast(o_orderkey div 4 % 3 as string)").alias("o"), F.lit("POS").alias("polarity"),
        F.round(F.least(F.lit(1.0), F.col("o_totalprice") / 399989.0), 9).alias("confidence"),
    )


@query(f"WITH {EDGES} SELECT id, triple_id, p, o, polarity, confidence, row_number() OVER (PARTITION BY id, p, polarity ORDER BY confidence DESC, triple_id) AS best_rank FROM edges WHERE confidence >= 0.65")
def edges_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ranked(edges(spark, sf_dir).where("confidence >= 0.65")).drop("is_best").withColumn("best_rank", F.col("best_rank").cast("long"))


@query(f"WITH {EDGES} SELECT id, triple_id, p, o, confidence FROM edges QUALIFY row_number() OVER (PARTITION BY id, p, polarity ORDER BY confidence DESC, triple_id) = 1")
def best_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ranked(edges(spark, sf_dir)).where("is_best").select("id", "triple_id", "p", "o", "confidence")


@query(f"WITH {VIOLATIONS} SELECT id, rule, array_to_string(triples, ',') AS triples, confidence, severity FROM violations")
def several_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conflicts.structural(edges(spark, sf_dir)).select("id", "violation.*")
    return found.select("id", "rule", F.array_join("supporting_triples", ",").alias("triples"), "confidence", "severity")


@query(f"""WITH {VIOLATIONS}, found AS (SELECT id, bool_or(severity = 'HARD') AS hard, count(*) AS n, max(confidence) AS c, array_to_string(list_sort(list_distinct(flatten(list(triples)))), ',') AS t FROM violations GROUP BY id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, triple_id) AS n FROM edges),
best AS (SELECT id, string_agg(triple_id, ',' ORDER BY n) FILTER (n <= 3) AS t, max(confidence) AS c FROM ranked GROUP BY id)
SELECT c_custkey AS id, CASE WHEN hard THEN 'UNSAT' WHEN f.id IS NOT NULL THEN 'SOFT_VIOLATIONS' ELSE 'SAT' END AS status, coalesce(n, 0) AS n_violations, coalesce(f.t, b.t, '') AS triples, round(coalesce(f.c, b.c, 0), 4) AS confidence
FROM customer LEFT JOIN found f ON f.id = c_custkey LEFT JOIN best b ON b.id = c_custkey""")
def constraint_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edges(spark, sf_dir)
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    made = conflicts.constraints(ids, conflicts.structural(rows), rows)
    return made.select("id", "status", F.size("violations").cast("long").alias("n_violations"), F.array_join("supporting_triples", ",").alias("triples"), "confidence")


@query("SELECT c_custkey AS id, predicate, type, severity FROM customer, (VALUES " + ", ".join(f"({quoted(g)})" for g in lexicon.GROUNDED) + ") g(predicate, type, severity)")
def grounded_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.grounded(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))).select("id", F.inline("constraints"))


SETS = f"""sets AS (SELECT source AS id, doc_id AS pos, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: NOT list_contains([{quoted(lexicon.SET_STOPWORDS)}], t)))) AS tokens FROM documents),
flagged AS (SELECT *, list_has_any(tokens, [{quoted(lexicon.SET_NEGATIONS)}]) AS neg FROM sets),
posts AS (SELECT id, pos, unnest(tokens) AS token FROM sets),
shared AS (SELECT a.id, a.pos AS i, b.pos AS j, count(*) AS shared FROM posts a JOIN posts b ON a.id = b.id AND a.token = b.token AND a.pos < b.pos GROUP BY ALL HAVING count(*) >= 2),
measured AS (SELECT s.*, s.shared / (len(a.tokens) + len(b.tokens) - s.shared) AS jac, a.neg <> b.neg AS unlike FROM shared s JOIN flagged a ON a.id = s.id AND a.pos = s.i JOIN flagged b ON b.id = s.id AND b.pos = s.j),
pairs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, i, j) AS nth FROM measured WHERE jac >= 0.2 OR (unlike AND jac >= 0.2 * 0.6))"""


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text")).select(F.col("source").alias("id"), F.col("doc_id").alias("pos"), F.concat(F.lit("t_"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("triple_id"), "text", (F.col("doc_id") % 100 / 100.0).alias("confidence"))


@query(f"WITH {SETS} SELECT id, i, j, shared, round(jac, 6) AS jaccard, unlike FROM pairs WHERE nth <= 400")
def statement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.candidate_pairs(stated(spark, sf_dir), CFG).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {SETS} SELECT id, CASE WHEN jac >= 0.92 THEN 'DuplicateClaims(A): near-identical supported claims' ELSE 'ContradictoryClaims(A): lexical negation mismatch in otherwise similar claims' END AS rule,
  't_' || lpad(CAST(i AS VARCHAR), 9, '0') || ',t_' || lpad(CAST(j AS VARCHAR), 9, '0') AS triples, CASE WHEN jac >= 0.92 THEN greatest(i % 100, j % 100) / 100.0::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM pairs WHERE nth <= 400 AND (jac >= 0.92 OR (unlike AND jac >= 0.35))""")
def statement_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stated(spark, sf_dir)
    found = conflicts.lexical(conflicts.candidate_pairs(rows, CFG), rows, CFG).select("id", "violation.*")
    return found.select("id", "rule", F.array_join("supporting_triples", ",").alias("triples"), "confidence")


@query("""WITH judged AS (SELECT o_custkey % 50 AS id, o_orderkey % 17 AS i, o_orderkey % 13 AS j, o_totalprice AS e, o_orderkey % 101 / 100.0::DOUBLE AS c FROM orders)
SELECT id, least(i, j) AS i, greatest(i, j) AS j, round(max(e), 6) AS entail, max(c) AS contradict FROM judged GROUP BY ALL""")
def symmetric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("id"), (F.col("o_orderkey") % 17).alias("i"), (F.col("o_orderkey") % 13).alias("j"), F.col("o_totalprice").alias("entail"), (F.col("o_orderkey") % 101 / 100.0).alias("contradict"))
    return conflicts.symmetric(rows).withColumn("entail", F.round("entail", 6))


JUDGED = f"""WITH {SETS}, judged AS (SELECT p.*, (i * 31 + j * 17) % 100 / 100.0::DOUBLE AS e, (i * 13 + j * 29) % 100 / 100.0::DOUBLE AS c, greatest(i % 100, j % 100) / 100.0::DOUBLE AS best FROM pairs p WHERE nth <= 400),
told AS (SELECT *, CASE WHEN jac >= 0.92 OR (e >= 0.6 AND c < 0.2) THEN 1 WHEN c >= 0.85 AND c >= e + 0.05 THEN 2 WHEN c >= 0.7 AND (jac >= 0.3 OR unlike) THEN 3 END AS k FROM judged)"""


@query(f"""{JUDGED} SELECT id, i, j, CASE k WHEN 2 THEN 'HARD' ELSE 'SOFT' END AS severity, round(CASE k WHEN 1 THEN greatest(best, e) WHEN 2 THEN 0.6 * c + 0.4 * best ELSE 0.5 * c + 0.5 * best END, 4) AS confidence FROM told WHERE k IS NOT NULL""")
def model_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations from probabilities of a model; here they come from the positions of a pair."""
    rows = stated(spark, sf_dir)
    pairs = conflicts.candidate_pairs(rows, CFG)
    i, j = F.col("i"), F.col("j")
    judged = pairs.select("id", "i", "j", ((i * 31 + j * 17) % 100 / 100.0).alias("entail"), ((i * 13 + j * 29) % 100 / 100.0).alias("contradict"))
    found = conflicts.by_model(pairs, judged, rows, CFG).select("id", "violation.*")
    at = lambda n: F.regexp_replace(F.get("supporting_triples", F.lit(n)), "^t_0*(?=.)", "").cast("long")
    return found.select("id", at(0).alias("i"), at(1).alias("j"), "severity", "confidence")


@query("""WITH told AS (SELECT c_custkey AS id, c_name, CASE c_custkey % 3 WHEN 0 THEN upper(c_name) WHEN 1 THEN 'mr ' || c_name ELSE 'nobody' END AS s FROM customer)
SELECT id, CASE WHEN id % 3 = 2 THEN s ELSE c_name END AS s FROM told""")
def aliases_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("char"), F.lit("b").alias("book_name"), F.lit("1").alias("claim_id"))
    said = F.when(F.col("id") % 3 == 0, F.upper("char")).when(F.col("id") % 3 == 1, F.concat(F.lit("mr "), "char")).otherwise(F.lit("nobody"))
    return graph.resolved(customers.select("id", said.alias("s")), graph.alias_table(customers), "s")



@query(f"""WITH named AS (SELECT s_suppkey AS id, replace(s_name, '#', ' ') AS name FROM supplier), split AS (SELECT *, string_split(name, ' ') AS w FROM named),
made AS (SELECT id, name, unnest([struct_pack(m := name, c := 1.0::DOUBLE), struct_pack(m := w[1], c := 0.55::DOUBLE)] || CASE WHEN len(w) > 1 THEN [struct_pack(m := w[-1], c := 0.65::DOUBLE)]
  || list_transform([{quoted(lexicon.GRAPH_TITLES)}], lambda t: struct_pack(m := upper(t[1]) || t[2:] || ' ' || w[-1], c := 0.4::DOUBLE)) ELSE [] END
  || list_transform([{quoted(lexicon.GRAPH_TITLES)}], lambda t: struct_pack(m := upper(t[1]) || t[2:] || ' ' || name, c := 0.25::DOUBLE))) AS a FROM split)
SELECT id, a.m AS mention, name AS canonical_entity, max(a.c) AS confidence FROM made GROUP BY ALL""")
def alias_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("char"), F.lit("b").alias("book_name"), F.lit("1").alias("claim_id"))
    return graph.alias_table(rows).select("id", "mention", "canonical_entity", "confidence")


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM part")
def mention_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", mention_key(F.col("p_name")).alias("k"))
