"""Retrieval for claims that arrive as a stream: each is answered from the index as it is then, and never revised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyproof.config import Retrieval
from storyproof.operators import retrieval


def answered(queries: DataFrame, index: retrieval.Index, cfg: Retrieval | None = None) -> DataFrame:
    """The batch answer of queries (query, corpus, terms) from an index of documents with chapter and bucket."""
    return retrieval.top_k(retrieval.pool(index, queries, cfg), cfg)


def answer_stream(claims: DataFrame, snapshot: Callable[[], retrieval.Index], write: Callable[[DataFrame, int], None], checkpoint: str, cfg: Retrieval | None = None, strict: bool = False, fallback: Callable[[], retrieval.Index] | None = None, every: str | None = None) -> StreamingQuery:
    """Starts answering a stream of queries, micro-batch by micro-batch.

    snapshot() gives the index as of a batch, such as the version of segments.py that is the last then; no batch reads the
    corpus, and what is added while it runs doesn't show in it. If it fails, fallback() is asked unless strict. write(answers,
    batch) must be idempotent by batch number, since a batch may be repeated after a failure. The stream ends when it has
    answered what is there, or asks every so often if told how.
    """

    def run(batch: DataFrame, number: int) -> None:
        try:
            index = snapshot()
        except Exception:
            if strict or fallback is None:
                raise
            index = fallback()
        write(answered(batch, index, cfg).withColumn("batch", F.lit(number)), number)

    asked = claims.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (asked.trigger(processingTime=every) if every else asked.trigger(availableNow=True)).start()
