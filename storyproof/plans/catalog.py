"""All named queries over the star-schema and text tables, and the SQL that gives the same rows."""

from storyproof.plans import evidence_queries, file_queries, graph_queries, measure_queries, report_queries, retrieval_queries, text_queries  # noqa: F401
from storyproof.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
