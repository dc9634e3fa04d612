"""Documents as chapters of long files, customers as characters with claims, their evidence and their dossiers."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.config import Verifier
from storyproof.functions import lexicon
from storyproof.functions import text as T
from storyproof.operators import chunking, conflicts, long_texts, report, retrieval, verify
from storyproof.plans.graph_queries import EDGES, edges
from storyproof.plans.registry import query, quoted, table
from storyproof.plans.text_queries import CFG, WINDOWS
from storyproof.sources import store

HEADED = dataclasses.replace(CFG, chapter_regex=r"(?m)^§§ document \d+$")


@query(f"""WITH filed AS (SELECT doc_id, '§§ document ' || CAST(doc_id AS VARCHAR) || chr(10) || coalesce(text, '') AS text FROM documents), {WINDOWS.replace("FROM documents", "FROM filed")}
SELECT doc_id, i AS nth, chunk_text, word_start, word_end, char_start FROM placed""")
def chunks_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents that are chapters of a few long text files, read in ranges; characters are counted from the chapter on."""
    folder = store.new_path(spark, "texts")
    heading = F.concat(F.lit("§§ document "), F.col("doc_id").cast("string"))
    table(spark, sf_dir, "documents").select(F.concat_ws("\n", heading, "text")).write.text(folder)
    found = long_texts.windows_of(spark, [folder], HEADED).withColumn("chapter_at", F.col("chapter_start"))
    store.remove(folder)
    made = chunking.described(found, F.lit("d"), HEADED)
    return made.select(F.regexp_extract("chapter_title", r"\d+$", 0).cast("long").alias("doc_id"), F.regexp_extract("chunk_id", r"w(\d+)$", 1).cast("long").alias("nth"), "chunk_text", "word_start", "word_end", (F.col("char_start") - F.col("chapter_at")).alias("char_start"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of one claim for each customer, the second of which counts."""
    said = F.array(F.lit("zz said something else first."), F.concat("c_name", F.lit(" lives in "), "c_mktsegment", F.lit(".")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("char"), F.array("c_name").alias("char_aliases"), F.lit("train").alias("split"), F.posexplode(said).alias("row", "claim_text"))
    form = F.array(T.predicate(F.col("char"), F.col("claim_text")))
    return rows.withColumns({"claim_id": F.concat(F.col("id").cast("string"), F.lit("_c01")), "predicate_form": form, "keywords": F.array(F.lit("Lives"), F.lit("in-town"))})


def _passage(key: Column, name: Column, segment: Column) -> Column:
    """Two sentences for most customers, a third that is contrary for some, and no name for some of these."""
    nobody = F.when(key % 6 == 0, F.lit("Nobody")).otherwise(name)
    sure = F.concat(nobody, F.lit(" never lives in "), segment, F.lit("."))
    return F.when(key % 3 == 0, F.concat(F.lit("It rained. "), sure)).otherwise(F.concat(F.lit("It rained. "), name, F.lit(" lives in town. Who lives in "), segment, F.lit("?")))


_SETS = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9'']+')), lambda t: NOT list_contains([{quoted(lexicon.SET_STOPWORDS)}], t))"
_NEGATED = f"len(list_intersect({{}}, [{quoted(lexicon.SET_NEGATIONS)}])) > 0"
_FIRST = "coalesce({}, {}, {}, '')"


def _best(label: str) -> str:
    return f"""coalesce(max(score) FILTER (label = '{label}'), 0) AS {label[:3].lower()}, nullif(coalesce(max_by(sentence, (score, -pos)) FILTER (label = '{label}' AND score > 0), ''), '') AS {label[:3].lower()}_sentence"""


@query(f"""WITH told AS (SELECT c_custkey AS id, c_name AS char, c_name || ' lives in ' || c_mktsegment || '.' AS claim_text, c_custkey % 100 / 100.0::DOUBLE AS lex,
  CASE WHEN c_custkey % 5 = 4 THEN [''] WHEN c_custkey % 3 = 0 THEN ['It rained.', CASE WHEN c_custkey % 6 = 0 THEN 'Nobody' ELSE c_name END || ' never lives in ' || c_mktsegment || '.']
    ELSE ['It rained.', c_name || ' lives in town.', 'Who lives in ' || c_mktsegment || '?'] END AS spans FROM customer),
spread AS (SELECT *, array_to_string(spans, ' ') AS passage, unnest(spans) AS sentence, unnest(range(len(spans))) AS pos FROM told),
sets AS (SELECT *, {_SETS.format("sentence")} AS p, {_SETS.format("claim_text")} AS h FROM spread),
shares AS (SELECT *, len(list_intersect(h, p)) / greatest(1, len(h)) AS share, ({_NEGATED.format("p")}) <> ({_NEGATED.format("h")}) AS unlike FROM sets),
judged AS (SELECT *, CASE WHEN share >= 1 - share THEN CASE WHEN unlike THEN 'CONTRADICT' ELSE 'SUPPORT' END ELSE 'NEUTRAL' END AS label, greatest(share, 1 - share) AS score FROM shares),
best AS (SELECT id, any_value(char) AS char, any_value(claim_text) AS claim_text, any_value(passage) AS passage, any_value(lex) AS lex, {_best("SUPPORT")}, {_best("CONTRADICT")}, {_best("NEUTRAL")} FROM judged GROUP BY id),
three AS (SELECT *, CASE WHEN sup >= 0.52 AND sup >= con + 0.04 THEN 'SUPPORT' WHEN con >= 0.78 AND con >= sup + 0.04 THEN 'CONTRADICT' ELSE 'NEUTRAL' END AS label FROM best),
mixed AS (SELECT *, least(1, greatest(0, 0.85 * CASE label WHEN 'SUPPORT' THEN sup WHEN 'CONTRADICT' THEN con ELSE greatest(neu, sup, con) END + 0.15 * lex)) AS conf,
  regexp_matches(lower(passage), '\\b(customer|' || regexp_extract(char, '[0-9]+$') || ')\\b') AS named FROM three)
SELECT id, CAST(id AS VARCHAR) || '_c01' AS claim_id, 'k' || CAST(id AS VARCHAR) AS chunk_id, claim_text, passage, CASE WHEN label = 'CONTRADICT' AND NOT named THEN 'NEUTRAL' ELSE label END AS label,
  round(CASE WHEN label = 'CONTRADICT' AND NOT named THEN least(conf, 0.65) ELSE conf END, 6) AS confidence,
  CASE label WHEN 'SUPPORT' THEN {_FIRST.format("sup_sentence", "neu_sentence", "con_sentence")} WHEN 'CONTRADICT' THEN {_FIRST.format("con_sentence", "neu_sentence", "sup_sentence")}
  ELSE coalesce(CASE WHEN neu >= sup AND neu >= con THEN neu_sentence WHEN sup >= con THEN sup_sentence ELSE con_sentence END, {_FIRST.format("sup_sentence", "con_sentence", "neu_sentence")}) END AS evidence_text FROM mixed""")
def evidence_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for the last row of each claim: every fifth chunk has no text, some contradictions don't name the character."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    chunk = F.concat(F.lit("k"), key.cast("string"))
    candidates = rows.select(key.alias("id"), F.concat(key.cast("string"), F.lit("_c01")).alias("claim_id"), F.lit("b").alias("book_name"), chunk.alias("chunk_id"), (key % 100 / 100.0).alias("score_lex_norm"))
    chunks = rows.where(key % 5 != 4).select(chunk.alias("chunk_id"), _passage(key, F.col("c_name"), F.col("c_mktsegment")).alias("chunk_text"))
    made = verify.evidence(candidates, _claims(spark, sf_dir), chunks, verify.LexicalJudge(), Verifier())
    return made.select("id", "claim_id", "chunk_id", "claim_text", "passage", "label", F.round("confidence", 6).alias("confidence"), "evidence_text")


@query("""WITH said AS (SELECT c_custkey AS id, unnest(range(2)) AS row, c_name AS char, c_mktsegment AS segment FROM customer),
told AS (SELECT *, CASE row WHEN 0 THEN 'zz said something else first.' ELSE char || ' lives in ' || segment || '.' END || ' lives in town ' || char AS all_text FROM said)
SELECT id, row, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(all_text), '[a-z0-9'']+'))), ' ') AS terms FROM told""")
def claim_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for a claim: the tokens of its text, keywords, character and predicate."""
    found = _claims(spark, sf_dir)
    return found.select("id", F.col("row").cast("long").alias("row"), F.array_join(F.array_sort(retrieval.query_terms(found)), " ").alias("terms"))


@query(f"WITH {EDGES} SELECT id, triple_id, o AS text, confidence FROM edges WHERE p = 'Claim' AND CAST(substr(triple_id, 3) AS BIGINT) % 3 = 0")
def claims_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of supported claims among all triples, a third of which are supported."""
    supported = F.substring("triple_id", 3, 99).cast("long") % 3 == 0
    triples = edges(spark, sf_dir).withColumn("support_label", F.when(supported, F.lit("SUPPORT")).otherwise(F.lit("NEUTRAL")))
    return conflicts.stated(triples).select("id", "triple_id", "text", "confidence")


_ROWS = r"""facts AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS k, c_name AS char, c_mktsegment AS segment, c_custkey % 100 / 100.0::DOUBLE AS conf FROM customer WHERE c_custkey % 6 <> 5),
lines AS (SELECT *, '| ' || CASE WHEN id % 4 = 0 THEN 'CONTRADICT' ELSE 'SUPPORT' END || ' | ' || printf('%.3f', conf) || ' | 1 | ' || printf('%.3f', conf) || ' | `k' || k || '` | ch001 | EARLY | ' || char || ' \| lives here |' AS a,
  '| NEUTRAL | 0.500 |  |  | `m' || k || '` |  |  |  |' AS b FROM facts)"""


@query(rf"""WITH {_ROWS}
SELECT id, id % 2 AS prediction, 'train' AS split, '# Evidence Dossier — id ' || k || chr(10) || chr(10) || '**book_name:** b  ' || chr(10) || '**target char:** ' || char || '  ' || chr(10)
  || CASE WHEN id % 3 = 0 THEN '**caption:** cap  ' || chr(10) ELSE '' END || '**split:** train  ' || chr(10) || '**prediction:** ' || CAST(id % 2 AS VARCHAR) || '  ' || chr(10) || '**logic_status:** SAT  ' || chr(10)
  || CASE WHEN id % 2 = 1 THEN '**rationale:** because' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || '## Key claims & linked evidence' || chr(10) || chr(10)
  || '### ' || k || '_c01  ' || chr(10) || '**type:** UNK | **t_hint:** UNK' || chr(10) || chr(10) || '**claim:** ' || char || ' lives in ' || segment || chr(10) || chr(10)
  || '| label | conf | rank | score_lex_norm | chunk_id | chapter | bucket | excerpt |' || chr(10) || '|---|---:|---:|---:|---|---|---|---|' || chr(10)
  || CASE WHEN id % 4 = 0 OR conf >= 0.5 THEN a || chr(10) || b ELSE b || chr(10) || a END || chr(10) || chr(10) || '---' || chr(10)
  || chr(10) || '### ' || k || '_c02  ' || chr(10) || '**type:** UNK | **t_hint:** UNK' || chr(10) || chr(10) || '**claim:** null and void' || chr(10) || chr(10) || '_No evidence found for this claim._' || chr(10) || '---' || chr(10) AS markdown FROM lines""")
def dossiers_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers of customers: two claims each, one without evidence; a passage that wasn't ranked; every sixth id has no claims."""
    key, name = F.col("c_custkey"), F.col("c_name")
    rows, k = table(spark, sf_dir, "customer"), key.cast("string")
    first, second = (F.concat(k, F.lit(f"_c0{i}")) for i in (1, 2))
    decisions = rows.select(key.alias("id"), (key % 2).alias("prediction"), F.lit("train").alias("split"), F.lit("SAT").alias("status"), F.when(key % 2 == 1, F.lit("because")).alias("rationale"))
    said = F.array(F.struct(first.alias("claim_id"), F.concat(name, F.lit(" lives in "), "c_mktsegment").alias("claim_text")), F.struct(second.alias("claim_id"), F.lit("null and void").alias("claim_text")))
    caption = F.when(key % 3 == 0, F.lit("cap"))
    claims = rows.where(key % 6 != 5).select(key.alias("id"), name.alias("char"), F.lit("b").alias("book_name"), caption.alias("caption"), F.lit("UNK").alias("claim_type"), F.lit("UNK").alias("t_hint"), F.array(F.lit("lives")).alias("keywords"), F.inline(said))
    confidence = key % 100 / 100.0
    ranked = F.struct(F.concat(F.lit("k"), k).alias("chunk_id"), F.when(key % 4 == 0, F.lit("CONTRADICT")).otherwise(F.lit("SUPPORT")).alias("label"), confidence.alias("confidence"))
    other = F.struct(F.concat(F.lit("m"), k).alias("chunk_id"), F.lit("NEUTRAL").alias("label"), F.lit(0.5).alias("confidence"))
    evidence = rows.select(key.alias("id"), first.alias("claim_id"), F.inline(F.array(ranked, other)))
    candidates = rows.select(key.alias("id"), first.alias("claim_id"), F.concat(F.lit("k"), k).alias("chunk_id"), F.lit(1).alias("rank"), confidence.alias("score_lex_norm"))
    chunks = rows.select(F.concat(F.lit("k"), k).alias("chunk_id"), F.lit("ch001").alias("chapter_id"), F.lit("EARLY").alias("time_bucket"), F.concat(name, F.lit(" | lives\nhere")).alias("chunk_text"))
    return report.dossiers(decisions, claims, evidence, candidates, chunks)
