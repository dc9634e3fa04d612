"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyproof.llm import chat, decontaminate, embeddings, licenses, packing, pii, ranking, resampling, secrets, simhash, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": packing.op1_pack,
    "op2_licenses": licenses.op2_licenses,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_secrets": secrets.op4_secrets,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_chat": chat.op9_chat,
    "op10_pii": pii.op10_pii,
    "op11_repeats": suffixes.op11_repeats,
    "op12_rank": ranking.op12_rank,
    "op13_resample": resampling.op13_resample,
}

SQL: dict[str, str] = {
    "op3_embeddings": embeddings.SQL,
    "op6_warc": warc.SQL,
    "op9_chat": chat.SQL,
    "op11_repeats": suffixes.SQL,
    "op12_rank": ranking.SQL,
    "op13_resample": resampling.SQL,
}
