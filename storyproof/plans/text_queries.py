"""Texts of documents, pages, customers and parts through chunking, statements and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyproof.config import Chunking
from storyproof.functions import lexicon, names, normal
from storyproof.functions import text as T
from storyproof.operators import chunking, statements, verify
from storyproof.plans.registry import query, quoted, table
from storyproof.sources.readers import spread

CFG = Chunking(window_words=60, overlap_words=10, min_chunk_words=20, chapter_regex="(?m)^[A-ZÀ-Ý][^ \\n]* [^\\n]*the[^\\n]*$")
STEP = CFG.step
WORD = r"\p{L}\p{M}\p{N}_"
UNMARK = "replace(replace({}, chr(2), ''), chr(3), '')"
CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def marked(x: str) -> str:
    """SQL that puts a mark before and behind each word, since boundaries of words are ASCII there."""
    return f"regexp_replace({x}, '([" + WORD + r"]+)', chr(2) || '\1' || chr(3), 'g')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n_tokens, array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9'']+'), 1, 20), ' ') AS head FROM documents")
def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.array_join(F.slice(words, 1, 20), " ").alias("head"))


SENTENCES = r"""sents AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.?!]["”’)\]])\s+', '\1' || chr(1), 'g'), '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS sentence,
  generate_subscripts(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.?!]["”’)\]])\s+', '\1' || chr(1), 'g'), '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''), 1) - 1 AS pos FROM documents)"""


@query(f"WITH {SENTENCES} SELECT doc_id, pos, sentence FROM sents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(r"SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '(?s).*?[.!?]+(?:\s+|$)|.+$') AS s FROM documents)")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentence_spans(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


CLAUSES = rf"""{SENTENCES},
marked AS (SELECT doc_id, pos, {CLEAN.format("sentence")} AS sentence FROM sents),
cut AS (SELECT doc_id, pos, string_split(regexp_replace(regexp_replace({marked("sentence")}, '(?i)\x02(and|but|while|because|so|however)\x03', chr(1), 'g'), '[;:()—–]| - ', chr(1), 'g'), chr(1)) AS parts FROM marked),
clauses AS (SELECT doc_id, pos, generate_subscripts(c, 1) AS nth, unnest(c) AS clause FROM (SELECT doc_id, pos, list_filter(list_transform(parts, lambda p: {CLEAN.format(UNMARK.format("p"))}), lambda p: p <> '') AS c FROM cut)),
judged AS (SELECT *, string_split(clause, ' ') AS words, regexp_matches(clause, '(?i)(^|[^{WORD}])({lexicon.FACT_WORDS})($|[^{WORD}])') AS facty FROM clauses),
kept AS (SELECT doc_id, pos, nth, CASE WHEN regexp_matches(clause, '[.!?]$') THEN clause ELSE clause || '.' END AS statement FROM judged
  WHERE facty OR (len(words) >= 4 AND (len(words) > 10 OR len(list_filter(words, lambda w: list_contains([{quoted(lexicon.STOPWORDS)}], lower(w)))) / len(words) <= 0.6))),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, nth) AS nth, statement FROM kept)"""


@query(f"WITH {CLAUSES} SELECT doc_id, nth, statement FROM numbered")
def statement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(statements.statements(F.col("text"), whole=False)).alias("_at", "statement")).select("doc_id", (F.col("_at") + 1).cast("long").alias("nth"), "statement")


WINDOWS = rf"""parts AS (SELECT doc_id, length(text) AS full_len, regexp_extract_all(text, '\S+') AS words FROM documents),
spots AS (SELECT *, unnest(range(0, CASE WHEN len(words) <= {CFG.window_words} THEN 1 ELSE CAST(ceil((len(words) - {CFG.window_words}) / {STEP}.0) AS INT) + 1 END)) AS i FROM parts WHERE len(words) > 0),
cut AS (SELECT doc_id, full_len, i, i * {STEP} AS word_start, least(len(words), i * {STEP} + {CFG.window_words}) AS word_end, array_to_string(words[i * {STEP} + 1 : i * {STEP} + {CFG.window_words}], ' ') AS chunk_text,
  CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(words[1 : i * {STEP}], ' ')) + 1 END AS char_start FROM spots),
placed AS (SELECT *, char_start + length(chunk_text) + 1 AS char_end, (char_start + char_start + length(chunk_text) + 1) / 2 / greatest(1, full_len) AS p FROM cut WHERE word_end - word_start >= {CFG.min_chunk_words} OR i = 0)"""


@query(f"""WITH {WINDOWS} SELECT doc_id, CAST(doc_id AS VARCHAR) || '_ch000_w' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id, chunk_text, round(p, 6) AS chunk_pos, word_start, word_end, char_start, char_end,
  CASE WHEN p <= 0.33 THEN 'EARLY' WHEN p <= 0.66 THEN 'MID' ELSE 'LATE' END AS time_bucket FROM placed""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = docs(spark, sf_dir).select("doc_id", F.length("text").alias("full_len"), F.lit("ch000").alias("chapter_id"), F.lit("NO_CHAPTER").alias("chapter_title"), F.col("text").alias("chapter_text"), F.lit(0).alias("chapter_start"))
    return chunking.windows(whole, F.col("doc_id").cast("string"), CFG).select("doc_id", "chunk_id", "chunk_text", "chunk_pos", "word_start", "word_end", "char_start", "char_end", "time_bucket")


LINES = r"""lines AS (SELECT doc_id, text, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
headed AS (SELECT *, regexp_matches(line, '^[A-ZÀ-Ý][^ \n]* [^\n]*the[^\n]*$') AS head, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS start FROM lines),
heads AS (SELECT doc_id, text, start, trim(line) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS nth, lead(start, 1, length(text)) OVER (PARTITION BY doc_id ORDER BY n) AS stop FROM headed WHERE head)"""


@query(f"""WITH {LINES} SELECT doc_id, 'ch' || lpad(CAST(nth AS VARCHAR), 3, '0') AS chapter_id, title AS chapter_title, CAST(start AS BIGINT) AS chapter_start, CAST(stop - start AS BIGINT) AS n_chars FROM heads
UNION ALL SELECT doc_id, 'ch000', 'NO_CHAPTER', 0, length(text) FROM documents d WHERE NOT EXISTS (FROM heads h WHERE h.doc_id = d.doc_id)""")
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chapters(docs(spark, sf_dir).select("doc_id", "text"), CFG.chapter_regex)
    return made.select("doc_id", "chapter_id", "chapter_title", F.col("chapter_start").cast("long").alias("chapter_start"), F.length("chapter_text").cast("long").alias("n_chars"))


def _counted(words: str, column: str) -> str:
    return f"""WITH found AS (SELECT doc_id, unnest({words}) AS w FROM documents), counted AS (SELECT doc_id, w, count(*) AS n FROM found GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rank, w AS {column}, n FROM counted QUALIFY rank <= 12"""


@query(_counted(rf"list_filter(list_transform(regexp_extract_all({marked('text')}, '\x02[A-Z][a-z]{{2,}}\x03'), lambda w: {UNMARK.format('w')}), lambda w: NOT list_contains([{quoted(lexicon.NOT_ENTITIES)}], w))", "entity"))
def entity_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.counted(docs(spark, sf_dir), ["doc_id"], chunking.entity_words(F.col("text")), 12, "entity")
    return made.withColumns({c: F.col(c).cast("long") for c in ("rank", "n")})


@query(_counted(rf"list_filter(regexp_extract_all(lower(text), '\p{{L}}[\p{{L}}\p{{M}}''-]+'), lambda w: length(w) >= 4 AND NOT list_contains([{quoted(lexicon.STOPWORDS)}], w))", "keyword"))
def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.counted(docs(spark, sf_dir), ["doc_id"], chunking.keyword_words(F.col("text")), 12, "keyword")
    return made.withColumns({c: F.col(c).cast("long") for c in ("rank", "n")})


KEY = "regexp_replace(lower(trim({})), '[^a-z0-9]+', '', 'g')"


@query(rf"""SELECT p_partkey, {CLEAN.format("translate(p_name || '  “x”  ’y’', '’‘“”', '''''\"\"')")} AS cleaned, trim(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS mention,
  {KEY.format("p_brand")} AS title, regexp_replace(p_type, '[^a-zA-Z0-9_-]+', '_', 'g') AS file, lower(strip_accents(p_name || ' Dantès')) AS plain FROM part""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.clean(F.concat("p_name", F.lit("  “x”  ’y’"))).alias("cleaned"), T.mention_key(F.col("p_type")).alias("mention"), T.title_key(F.col("p_brand")).alias("title"), T.file_key(F.col("p_type")).alias("file"), normal.plain(F.concat("p_name", F.lit(" Dantès"))).alias("plain"))


@query("""SELECT c_custkey, 'Claim("' || c_name || '", "owes ''' || c_mktsegment || ''', still")' AS predicate, 'Claim' AS name, c_name AS first_arg, 'owes ''' || c_mktsegment || ''', still' AS second_arg, 3 AS n_split FROM customer""")
def predicate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit('owes "'), "c_mktsegment", F.lit('",  still'))
    made = table(spark, sf_dir, "customer").select("c_custkey", T.predicate(F.col("c_name"), said).alias("predicate"))
    args = T.predicate_args(F.col("predicate"))
    return made.select("c_custkey", "predicate", T.predicate_name(F.col("predicate")).alias("name"), args[0].alias("first_arg"), args[1].alias("second_arg"), F.size(T.predicate_args(F.col("predicate"), whole_object=False)).alias("n_split"))


def _alias_sql() -> str:
    titles = [x for t in lexicon.DOTTED_TITLES for x in (t, f"{t}.")] + lexicon.PLAIN_TITLES
    return f"""WITH named AS (SELECT s_suppkey, {CLEAN.format("replace(s_name, '#', ' ')")} AS name FROM supplier), split AS (SELECT *, string_split(name, ' ') AS w FROM named),
made AS (SELECT s_suppkey, unnest(CASE WHEN len(w) > 1 THEN [name, w[1], w[-1], w[1] || ' ' || w[-1]] || list_transform([{quoted(titles)}], lambda t: t || ' ' || w[-1]) ELSE [name, w[1]] END) AS alias FROM split),
once AS (SELECT DISTINCT s_suppkey, alias FROM made WHERE alias <> '' AND lower(alias) <> 'none')
SELECT s_suppkey, alias FROM once QUALIFY row_number() OVER (PARTITION BY s_suppkey, lower(alias) ORDER BY alias COLLATE C) = 1"""


@query(_alias_sql().replace(" COLLATE C", ""))
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(names.aliases(F.replace("s_name", F.lit("#"), F.lit(" ")))).alias("alias"))


@query(f"""WITH titles AS (SELECT n_name AS title, n_nationkey AS position, {KEY.format("n_name")} AS k FROM nation), asked AS (SELECT c_custkey, upper(n_name) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' - a story' ELSE ' ?' END AS book,
  c_custkey % 7 = 0 AS strange FROM customer JOIN nation ON c_nationkey = n_nationkey), named AS (SELECT c_custkey, CASE WHEN strange THEN 'zz' ELSE book END AS book FROM asked),
keyed AS (SELECT *, {KEY.format("book")} AS own FROM named)
SELECT c_custkey, book AS raw_book_name, coalesce((SELECT title FROM titles WHERE own <> '' AND (own = k OR contains(own, k) OR contains(k, own)) ORDER BY own <> k, position LIMIT 1), book) AS book_name FROM keyed""")
def title_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    end = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.lit(" - a story")).otherwise(F.lit(" ?"))
    asked = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = asked.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit("zz")).otherwise(F.concat(F.upper("n_name"), end)).alias("book_name"))
    return statements.remap_titles(asked, nation.select(F.col("n_name").alias("book_name"), F.col("n_nationkey").alias("position"))).select("c_custkey", "raw_book_name", "book_name")


@query("SELECT s_suppkey, coalesce((SELECT min(r_name) FROM region WHERE lower(trim(r_name)) = lower(trim(CASE s_suppkey % 3 WHEN 0 THEN ' ASIA ' WHEN 1 THEN 'europe' ELSE 'Atlantis' END))), s_name) AS place FROM supplier")
def dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit(" ASIA "), F.lit("europe"), F.lit("Atlantis")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    known = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_name").alias("value"))
    return statements.looked_up(table(spark, sf_dir, "supplier"), said, known, "place", F.col("s_name")).select("s_suppkey", "place")


@query(r"""WITH t AS (SELECT doc_id, text, instr(lower(text), ' the ') AS a, instr(lower(text), ' que ') AS b FROM documents), f AS (SELECT *, CASE WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 END AS i FROM t),
s AS (SELECT *, greatest(0, i - 120) AS x, least(length(text), i + 120) AS y FROM f)
SELECT doc_id, CASE WHEN i IS NULL THEN substring(text, 1, 320) || CASE WHEN length(text) > 320 THEN '…' ELSE '' END
  ELSE CASE WHEN x > 0 THEN '…' ELSE '' END || trim(substring(text, CAST(x + 1 AS BIGINT), CAST(y - x AS BIGINT))) || CASE WHEN y < length(text) THEN '…' ELSE '' END END AS excerpt FROM s""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.excerpt(F.col("text"), F.array(F.lit(" the "), F.lit(" que "))).alias("excerpt"))


@query(r"""WITH t AS (SELECT doc_id, text, substring(text, 11, 12) AS needle FROM documents)
SELECT doc_id, CASE WHEN needle = '' THEN NULL ELSE instr(text, needle) - 1 END AS exact_start, CASE WHEN needle = '' THEN NULL ELSE instr(text, needle) - 1 + length(needle) END AS exact_end,
  CASE WHEN instr(lower(text), 'the') > 0 THEN greatest(0, instr(lower(text), 'the') - 41) END AS near_start, CASE WHEN instr(lower(text), 'the') > 0 THEN least(length(text), instr(lower(text), 'the') + 89) END AS near_end FROM t""")
def spans_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage found as it stands, and a mention found by its first word."""
    made = docs(spark, sf_dir).select("doc_id", T.located(F.col("text"), F.substring("text", 11, 12)).alias("a"), T.fuzzily_located(F.col("text"), F.lit("THE zzzzzz")).alias("b"))
    return made.select("doc_id", *(F.col(c).cast("long").alias(n) for c, n in (("a.start", "exact_start"), ("a.end", "exact_end"), ("b.start", "near_start"), ("b.end", "near_end"))))


@query(None)
def sentence_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most telling sentences of each document for a statement about its language; sentences are compared without accents."""
    rows = docs(spark, sf_dir).select("doc_id", F.col("text").alias("passage"), F.lit("They never heard of the author and the reason").alias("claim_text"), F.array(F.col("lang")).alias("aliases"))
    return verify.sentence_scores(rows, ["doc_id"], 3)


_NAME_WORDS = r"list_filter(string_split_regex(regexp_replace({}, '[^a-z0-9\s'']', ' ', 'g'), '\s+'), lambda w: w <> '')"
_ANCHORED = rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS p FROM documents),
w AS (SELECT *, regexp_extract_all(lower(p), '[a-z0-9'']+') AS toks, regexp_extract_all(lower(substring(p, 1, 80)), '[a-z0-9'']+') AS claim FROM t),
n AS (SELECT *, CASE WHEN len(toks) >= 4 THEN [toks[3] || ' ' || toks[4]] ELSE [] END AS full_names FROM w),
a AS (SELECT *, list_distinct(flatten(list_transform(full_names, lambda x: [x] || CASE WHEN len({_NAME_WORDS.format("x")}) >= 2 THEN list_filter([{_NAME_WORDS.format("x")}[1], {_NAME_WORDS.format("x")}[-1]], lambda y: length(y) >= 3) ELSE [] END))) AS names FROM n),
c AS (SELECT *, list_filter(list_distinct(claim), lambda x: length(x) >= 3 AND NOT list_contains([{quoted(lexicon.NEGATIONS)}], x) AND NOT list_contains(flatten(list_transform(names, lambda y: {_NAME_WORDS.format("y")})), x)) AS anchors,
  list_filter(list_transform(regexp_extract_all(p, '(?s).*?[.!?]+(?:\s+|$)|.+$'), lambda x: trim(x)), lambda x: x <> '') AS spans FROM a),
s AS (SELECT doc_id, anchors, names, CASE WHEN len(spans) > 0 THEN spans ELSE [trim(substring(p, 1, 400))] END AS spans FROM c),
e AS (SELECT doc_id, anchors, names, unnest(range(len(spans))) AS pos, unnest(spans) AS sentence FROM s),
l AS (SELECT *, trim(regexp_replace(lower(replace(sentence, '`', '''')), '\s+', ' ', 'g')) AS plain FROM e),
h AS (SELECT doc_id, pos, sentence, len(list_filter(anchors, lambda x: regexp_matches(plain, '\b' || x || '\w*\b'))) AS hits,
  len(list_filter(names, lambda x: len({_NAME_WORDS.format("x")}) > 0 AND regexp_matches(plain, '\b' || array_to_string({_NAME_WORDS.format("x")}, '\s+') || '\b'))) > 0 AS named FROM l),
r AS (SELECT *, CASE WHEN named THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + least(2.0::DOUBLE, 0.6::DOUBLE * hits) + least(0.4::DOUBLE, length(sentence) / 600.0::DOUBLE) AS score FROM h)
SELECT doc_id, pos, sentence, round(score, 9) AS sent_score FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 3"""


@query(_ANCHORED)
def anchored_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most telling sentences of each document for how it begins, a name being its third and fourth word; other letters than ASCII are spaces."""
    ascii_text = docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("passage"))
    told = ascii_text.withColumn("_t", T.tokens(F.col("passage"))).withColumn("claim_text", F.substring("passage", 1, 80))
    name = F.when(F.size("_t") >= 4, F.array(F.concat(F.col("_t")[2], F.lit(" "), F.col("_t")[3]))).otherwise(F.array().cast("array<string>"))
    found = verify.sentence_scores(told.withColumn("aliases", name), ["doc_id"], 3)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", F.round("sent_score", 9).alias("sent_score"))


@query(f"""WITH told AS (SELECT c_custkey, c_name AS char, CASE c_custkey % 5 WHEN 0 THEN 'his debt grew.' WHEN 1 THEN 'She paid in full.' WHEN 2 THEN 'them all paid.' WHEN 3 THEN 'Mother died.' ELSE c_name || ' paid.' END AS said FROM customer)
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN char || '''s debt grew.' WHEN 1 THEN char || ' paid in full.' WHEN 2 THEN char || ' all paid.' WHEN 3 THEN char || '''s Mother died.' ELSE said END AS claim FROM told""")
def standalone_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("his debt grew."), F.lit("She paid in full."), F.lit("them all paid."), F.lit("Mother died."), F.concat("c_name", F.lit(" paid."))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.standalone(F.col("c_name"), names.aliases(F.col("c_name")), said).alias("claim"))
