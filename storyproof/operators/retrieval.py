"""BM25 over an inverted index, a corpus at a time, and top-K under constraints.

The index is postings in blocks and the blocks' sizes as stored tables: texts are read once, when it is built. A block is some
thousand documents of one corpus; one row of it holds a term's postings in the block. All counts are sums over blocks, so an
index can grow by segments that each have blocks of their own. A search keeps only the blocks' rows of terms that some query
has. Documents without any query term score 0; the pool needs at most as many of those as it has places, so just the first
of each corpus are joined in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from storyproof.config import Retrieval
from storyproof.functions.lexicon import BUCKETS
from storyproof.functions.text import tokens
from storyproof.sources.store import materialize

#: Documents and bytes of text of a block, on average, and queries that one task holds against a block.
BLOCK_DOCS, BLOCK_BYTES, QUERIES_PER_TASK = 2048, 16 << 20, 500


@dataclass(frozen=True)
class Index:
    """docs (corpus, doc and whatever else but the text), blocks (corpus, block, term, df, words, entries array of doc, f, dl) and sizes (corpus, block, n, words).

    df of a row of blocks is the number of the block's documents that hold the term, words that of its occurrences there.
    """

    docs: DataFrame
    blocks: DataFrame
    sizes: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(corpus, doc, term, f, dl)."""
        return self.blocks.select("corpus", "term", F.inline("entries")).select("corpus", "doc", "term", "f", "dl")

    @property
    def corpora(self) -> DataFrame:
        """(corpus, n, avgdl)."""
        return self.sizes.groupBy("corpus").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))

    def weights(self, wanted: DataFrame | None = None) -> DataFrame:
        """(corpus, term, df, idf, avgdl) of all terms, or of those wanted (corpus, term)."""
        terms = self.blocks.select("corpus", "term", "df")
        terms = terms if wanted is None else terms.join(wanted, ["corpus", "term"], "left_semi")
        return terms.groupBy("corpus", "term").agg(F.sum("df").alias("df")).join(self.corpora, "corpus").select("corpus", "term", "df", _idf().alias("idf"), "avgdl")


def build(docs: DataFrame, text: str = "text", keep: Callable[[DataFrame, str], DataFrame] = materialize, segment: int = 0) -> Index:
    """The index of docs (corpus, doc, text and whatever else); building again gives a new one.

    keep stores a table and gives it back as stored. Texts are read once more for their sizes, which say into how many blocks of
    at most about BLOCK_DOCS documents and BLOCK_BYTES a corpus is dealt; a block's documents are counted together. The numbers
    of the blocks begin with that of the segment, so that blocks of several segments can be together.
    """
    size = F.coalesce(F.sum(F.octet_length(F.col(text).cast("binary"))), F.lit(0))
    shares = _shares(docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), size.alias("size")), keep)
    read = docs.join(shares, "corpus").select("corpus", _block(segment), "doc", tokens(F.col(text)).alias("tokens"))

    def of_block(rows: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        lists = rows.column("tokens").combine_chunks()
        dl = lists.value_lengths().to_numpy()
        coded = lists.flatten().dictionary_encode()
        key, f = np.unique(coded.indices.to_numpy().astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
        term, doc = np.divmod(key, max(1, len(dl)))
        first = np.flatnonzero(np.diff(term, prepend=-1))
        struct = pa.StructArray.from_arrays([rows.column("doc").combine_chunks().take(pa.array(doc)), pa.array(f, pa.int32()), pa.array(dl[doc], pa.int32())], ["doc", "f", "dl"])
        entries = pa.ListArray.from_arrays(pa.array(np.append(first, len(term)), pa.int32()), struct)
        words = np.add.reduceat(f, first) if len(first) else f
        once = pa.array(np.zeros(len(first), dtype=np.int64))
        same = [rows.column(c).combine_chunks().take(once) for c in ("corpus", "block")]
        return pa.table([*same, coded.dictionary.take(pa.array(term[first])), pa.array(np.diff(np.append(first, len(term)))), pa.array(words, pa.int64()), entries], ["corpus", "block", "term", "df", "words", "entries"])

    corpus, doc = (docs.schema[c].dataType for c in ("corpus", "doc"))
    entry = StructType([StructField("doc", doc), StructField("f", IntegerType()), StructField("dl", IntegerType())])
    schema = StructType([StructField("corpus", corpus), StructField("block", LongType()), StructField("term", StringType()), StructField("df", LongType()), StructField("words", LongType()), StructField("entries", ArrayType(entry))])
    return _with_sizes(docs.drop(text), shares, keep(read.groupBy("corpus", "block").applyInArrow(of_block, schema), "blocks"), keep, segment)


def blocked(postings: DataFrame, docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialize, segment: int = 0) -> Index:
    """The index of postings (corpus, doc, term, f, dl) of docs (corpus, doc and whatever else); texts aren't needed any more."""
    words = postings.groupBy("corpus").agg((F.sum("f") * 8).alias("size"))
    shares = _shares(docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).join(words, "corpus", "left"), keep)
    entry = F.struct("doc", F.col("f").cast("int").alias("f"), F.col("dl").cast("int").alias("dl"))
    listed = postings.join(shares, "corpus").groupBy("corpus", _block(segment), "term").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("words"), F.collect_list(entry).alias("entries"))
    return _with_sizes(docs, shares, keep(listed, "blocks"), keep, segment)


def _shares(counted: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(corpus, _shares), the number of blocks of each corpus of so many documents n and bytes."""
    return keep(counted.select("corpus", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.coalesce("size", F.lit(0)) / BLOCK_BYTES)).alias("_shares")), "shares")


def _block(segment: int) -> Column:
    return (F.lit(segment << 32) + F.pmod(F.xxhash64("doc"), F.col("_shares"))).alias("block")


def _with_sizes(docs: DataFrame, shares: DataFrame, blocks: DataFrame, keep: Callable[[DataFrame, str], DataFrame], segment: int) -> Index:
    of_docs = docs.join(shares, "corpus").groupBy("corpus", _block(segment)).agg(F.count(F.lit(1)).alias("n"))
    of_words = blocks.groupBy("corpus", "block").agg(F.sum("words").alias("words"))
    sizes = keep(of_docs.join(of_words, ["corpus", "block"], "left").select("corpus", "block", "n", F.coalesce("words", F.lit(0)).alias("words")), "sizes")
    return Index(docs, blocks, sizes)


def _idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def weight(k1: float, b: float) -> Column:
    f, dl, avgdl = F.col("f"), F.col("dl"), F.col("avgdl")
    return F.col("idf") * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, corpus, term) of queries (query, corpus, terms array), and the distinct (corpus, term), to be broadcast if few."""
    asked = queries.select("query", "corpus", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = asked.select("corpus", "term").distinct()
    return asked, F.broadcast(wanted) if _few(wanted) else wanted


def scores(index: Index, queries: DataFrame, cfg: Retrieval | None = None) -> DataFrame:
    """(query, corpus, doc, score) of every document with a term of the query; queries (query, corpus, terms array).

    How often a query has a term doesn't count. Scores are rounded to nine places, so that the order in which a shuffle brings
    the addends doesn't decide between equal documents. Each query's documents are as many rows; best() is for the first few.
    Scores are added up within blocks, so neither postings nor scores are shuffled by document.
    """
    return _added(index, queries, cfg or Retrieval(), None)


def best(index: Index, queries: DataFrame, cfg: Retrieval | None = None) -> DataFrame:
    """Of each block the rows of scores() that can be among a query's candidate_pool best: those and what ties with the last.

    A group is a block with some of the queries that ask its corpus. It adds up a query's scores term by term in one dense array
    of the block's documents, so only the best of a block become rows, however common the terms are. The groups are bounded by
    BLOCK_DOCS and QUERIES_PER_TASK, a corpus of any size is so many more of them.
    """
    cfg = cfg or Retrieval()
    return _added(index, queries, cfg, cfg.candidate_pool)


def _added(index: Index, queries: DataFrame, cfg: Retrieval, most: int | None) -> DataFrame:
    """scores(), of each block only what can be among the best so many, or all."""
    asked, wanted = _asked(queries)
    told = asked.join(index.weights(wanted), ["corpus", "term"]).groupBy("query", "corpus").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs"), F.first("avgdl").alias("avgdl"))
    slices = told.groupBy("corpus").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("_slices"))
    of_corpus = index.sizes.groupBy("corpus").agg(F.collect_list("block").alias("_blocks")).join(slices, "corpus")
    left = told.join(of_corpus, "corpus").select("corpus", F.explode("_blocks").alias("block"), F.pmod(F.xxhash64("query"), F.col("_slices")).cast("int").alias("slice"), "query", "terms", "idfs", "avgdl")
    right = index.blocks.join(wanted, ["corpus", "term"], "left_semi").join(slices, "corpus").select("corpus", "block", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("slice"), "term", "entries")
    schema = StructType([*(queries.schema[c] for c in ("query", "corpus")), StructField("doc", index.docs.schema["doc"].dataType), StructField("score", DoubleType())])
    k1, b = cfg.k1, cfg.b

    def of_block(queries: pa.Table, rows: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        entries = rows.column("entries").combine_chunks()
        flat = entries.flatten()
        coded = flat.field("doc").dictionary_encode("encode")
        at, f, dl = coded.indices.to_numpy(), *(flat.field(c).to_numpy().astype(np.float64) for c in ("f", "dl"))
        ends = np.cumsum(entries.value_lengths().to_numpy())
        lists = {t: slice(e - n, e) for t, e, n in zip(rows.column("term").to_pylist(), ends.tolist(), entries.value_lengths().to_pylist(), strict=True)}
        avgdl = queries.column("avgdl")[0].as_py() if queries.num_rows else 1.0
        part = f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))
        which, docs, found = [], [], []
        for q, (terms, idfs) in enumerate(zip(queries.column("terms").to_pylist(), queries.column("idfs").to_pylist(), strict=True)):
            total = np.zeros(len(coded.dictionary))
            for t, idf in zip(terms, idfs, strict=True):
                if t in lists:
                    np.add.at(total, at[lists[t]], idf * part[lists[t]])
            hit = np.flatnonzero(total > 0)
            if most is not None and len(hit) > most:  # scores are compared when rounded to nine places
                hit = hit[total[hit] >= np.partition(total[hit], len(hit) - most)[len(hit) - most] - 2e-9]
            which.append(np.full(len(hit), q))
            docs.append(hit)
            found.append(total[hit])
        joined = [np.concatenate([np.zeros(0, dtype=k), *x]) for x, k in ((which, np.int64), (docs, np.int64), (found, np.float64))]
        asked = pa.array(joined[0])
        return pa.table([queries.column("query").combine_chunks().take(asked), queries.column("corpus").combine_chunks().take(asked), coded.dictionary.take(pa.array(joined[1])), pa.array(joined[2])], ["query", "corpus", "doc", "score"])

    keys = ["corpus", "block", "slice"]
    made = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(of_block, schema)
    return made.withColumn("score", F.round("score", 9))


FEW = 1_000_000


def _few(wanted: DataFrame) -> bool:
    """Whether the asked terms are few enough to be sent to every executor: their number is counted first."""
    return wanted.limit(FEW + 1).count() <= FEW


def pool(index: Index, queries: DataFrame, cfg: Retrieval | None = None, meta: tuple[str, ...] = ("chapter", "bucket")) -> DataFrame:
    """The best documents of each query's corpus: query, corpus, doc, score, norm, place and meta; ties go by doc.

    score_norm is the score between the worst (0) and the best (1) of the pool, 0 where all are equal. A query whose corpus
    is unknown has none.
    """
    cfg = cfg or Retrieval()
    first = Window.partitionBy("corpus").orderBy("doc")
    head = index.docs.select("corpus", "doc").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cfg.candidate_pool).drop("_n")
    zero = queries.select("query", "corpus").distinct().join(head, "corpus").withColumn("score", F.lit(0.0))
    scored = best(index, queries, cfg)
    both = scored.unionByName(zero).groupBy("query", "corpus", "doc").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query", "corpus").orderBy(F.desc("score"), "doc")
    top = both.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cfg.candidate_pool)
    of = Window.partitionBy("query", "corpus")
    low, high = F.min("score").over(of), F.max("score").over(of)
    normed = top.withColumn("score_norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(0.0)))
    return normed.join(index.docs.select("corpus", "doc", *meta), ["corpus", "doc"])


def top_k(pooled: DataFrame, cfg: Retrieval | None = None, by: tuple[str, ...] = ("query", "corpus")) -> DataFrame:
    """The best k of each pool with at most so many a chapter, ranked in the order of selection: pooled with rank.

    With buckets, the best document of each of EARLY, MID and LATE that its chapter has room for comes first, whatever k is.
    """
    cfg = cfg or Retrieval()
    keys = list(by)
    seeds = pooled.withColumn("_seed", F.lit(None).cast("int"))
    if cfg.enforce_buckets:
        for i, name in enumerate(BUCKETS):
            taken = F.count("_seed").over(Window.partitionBy(*keys, "chapter"))
            seeds = seeds.withColumn("_free", (F.col("bucket") == name) & F.col("_seed").isNull() & (taken < cfg.max_per_chapter))
            best = F.row_number().over(Window.partitionBy(*keys, "_free").orderBy("place"))
            seeds = seeds.withColumn("_best", best).withColumn("_seed", F.when(F.col("_free") & (F.col("_best") == 1), F.lit(i)).otherwise(F.col("_seed"))).drop("_free", "_best")
    held = F.count("_seed").over(Window.partitionBy(*keys, "chapter"))
    seeded = F.count("_seed").over(Window.partitionBy(*keys))
    counted = seeds.withColumns({"_held": held, "_seeded": seeded, "_is_seed": F.col("_seed").isNotNull()})
    nth = F.row_number().over(Window.partitionBy(*keys, "chapter", "_is_seed").orderBy("place"))
    roomy = counted.withColumn("_nth", nth).where(F.col("_is_seed") | (F.col("_nth") <= cfg.max_per_chapter - F.col("_held")))
    filled = F.row_number().over(Window.partitionBy(*keys, "_is_seed").orderBy("place"))
    kept = roomy.withColumn("_filled", filled).where(F.col("_is_seed") | (F.col("_filled") <= cfg.k - F.col("_seeded")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("_seed", F.lit(len(BUCKETS))), "place"))
    return kept.withColumn("rank", rank).drop(*(c for c in kept.columns if c.startswith("_")))


def coverage(queries: DataFrame, selected: DataFrame, by: tuple[str, ...] = ("query", "corpus")) -> DataFrame:
    """For each query, found or not: k_found, buckets_covered, unique_chapters."""
    found = selected.groupBy(*by).agg(F.count(F.lit(1)).alias("k_found"), F.count_distinct("bucket").alias("buckets_covered"), F.count_distinct("chapter").alias("unique_chapters"))
    return queries.select(*by).distinct().join(found, list(by), "left").na.fill(0, ["k_found", "buckets_covered", "unique_chapters"])


def query_terms(claims: DataFrame) -> Column:
    """Tokens of a claim's text, keywords, character and predicate arguments."""
    from storyproof.functions.text import predicate_args

    parts = [tokens(F.col("claim_text")), F.flatten(F.transform("keywords", tokens)), tokens(F.col("char")), F.flatten(F.transform(F.flatten(F.transform("predicate_form", lambda p: predicate_args(p, whole_object=False))), tokens))]
    return F.array_distinct(F.concat(*parts))
