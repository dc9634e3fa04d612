"""The knowledge graph: weighted aliases, and triples with canonical names, provenance and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyproof.functions import lexicon, names
from storyproof.functions import text as T
from storyproof.operators import statements
from storyproof.sources.store import materialize


def alias_table(claims: DataFrame, run_id: str = "") -> DataFrame:
    """(id, book_name, mention, canonical_entity, entity_type, confidence, run_id) of the first character of each id, once a mention."""
    first = characters(claims)
    rows = first.select("id", "book_name", F.col("char").alias("canonical_entity"), F.inline(names.weighted_aliases(F.col("char"))))
    return rows.groupBy("id", "book_name", "mention", "canonical_entity").agg(F.max("confidence").alias("confidence")).select("id", "book_name", "mention", "canonical_entity", F.lit("CHAR").alias("entity_type"), "confidence", F.lit(run_id).alias("run_id"))


def characters(claims: DataFrame) -> DataFrame:
    """(id, char, book_name) of the first claim of each id."""
    made = statements.order(claims)
    return claims.groupBy("id").agg(F.min_by("char", made).alias("char"), F.min_by("book_name", made).alias("book_name"))


def resolved(rows: DataFrame, aliases: DataFrame, mention: str, only: Column | None = None) -> DataFrame:
    """rows (id, mention, …) with the mention replaced by the canonical name if it is an alias of the id, where only holds."""
    known = aliases.select("id", T.mention_key(F.col("mention")).alias("_key"), F.col("canonical_entity").alias("_name"))
    known = known.unionByName(aliases.select("id", T.mention_key(F.col("canonical_entity")).alias("_key"), F.col("canonical_entity").alias("_name"))).groupBy("id", "_key").agg(F.min("_name").alias("_name"))
    keyed = rows.withColumn("_key", T.mention_key(F.col(mention)) if only is None else F.when(only, T.mention_key(F.col(mention))))
    return keyed.join(known, ["id", "_key"], "left").withColumn(mention, F.coalesce("_name", mention)).drop("_key", "_name")


def triples(facts: DataFrame, chunks: DataFrame, evidence: DataFrame, aliases: DataFrame, least: float = 0.65, run_id: str = "") -> DataFrame:
    """The triple table of facts with enough confidence; what a fact lacks comes from the evidence of its claim and chunk."""
    meta = chunks.dropDuplicates(["chunk_id"]).select("chunk_id", F.col("book_name").alias("_book"), "time_bucket", "chapter_id", "chunk_pos", F.col("chunk_text").alias("_text"))
    # of several rows of one claim and chunk one whole row counts, that of the largest id
    told = evidence.groupBy("claim_id", "chunk_id").agg(F.max(F.struct("id", "confidence", "label", "evidence_text")).alias("_row")).select("claim_id", "chunk_id", F.col("_row.label").alias("_label"), F.col("_row.confidence").alias("_conf"), F.col("_row.evidence_text").alias("_said"))
    rows = facts.where(F.coalesce("fact_confidence", "confidence") >= least).join(meta, "chunk_id", "left").join(told, ["claim_id", "chunk_id"], "left")
    full = lambda *c: F.coalesce(*(F.nullif(F.trim(F.col(x)), F.lit("")) for x in c), F.lit(""))
    rows = rows.withColumns({"support_label": full("label", "_label"), "evidence_confidence": F.coalesce("confidence", "_conf", F.lit(0.0)), "_said": full("excerpt", "_said"), "_text": F.coalesce("_text", F.lit("")), "book_name": F.coalesce("_book", "book_name")})
    rows = resolved(resolved(rows, aliases, "s"), aliases, "o", F.col("p").isin(*lexicon.PERSON_RELATIONS))
    text = F.col("_text")
    own = F.when((F.col("span_start") >= 0) & (F.col("span_start") < F.col("span_end")) & (F.col("span_end") <= F.length(text)), F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")))
    span = F.coalesce(T.located(text, F.col("_said")), own, *(T.fuzzily_located(text, F.col(c)) for c in "ops"), F.struct(F.lit(0).alias("start"), F.least(F.lit(180), F.length(text)).alias("end")))
    made = numbered(rows.withColumn("excerpt_span", span))
    excerpt = F.when(F.col("_said") != "", F.col("_said")).otherwise(F.substring(text, F.col("excerpt_span.start") + 1, F.col("excerpt_span.end") - F.col("excerpt_span.start")))
    return ranked(made.withColumn("excerpt_text", excerpt).select("triple_id", "id", "claim_id", "book_name", "s", "p", "o", "time_bucket", "polarity", F.col("fact_confidence").alias("confidence"), "evidence_confidence", "chunk_id", "excerpt_span", "excerpt_text", "chapter_id", "chunk_pos", "support_label", F.lit(run_id).alias("run_id")))


def ranked(edges: DataFrame) -> DataFrame:
    """edges with best_rank within (id, p, polarity) by confidence, ties by triple_id, and is_best."""
    order = Window.partitionBy("id", "p", "polarity").orderBy(F.desc("confidence"), "triple_id")
    return edges.withColumn("best_rank", F.row_number().over(order)).withColumn("is_best", F.col("best_rank") == 1)


def numbered(edges: DataFrame) -> DataFrame:
    """edges with triple_id t_00001, t_00002 and so on in the order of id, claim, chunk, relation and object.

    Numbers run on over all rows without bringing them to one task: rows are dealt by ranges and sorted, and each part counts
    from the number of rows in the parts before it.
    """
    keys = ["id", "claim_id", "chunk_id", "p", "o"]
    parts = materialize(edges.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    parts = parts.withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a part
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(starts), "_part").withColumn("triple_id", F.format_string("t_%05d", nth)).drop("_at", "_part", "_before")
