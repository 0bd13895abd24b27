"""All named queries and their reference SQL."""

from foliospark.plans import corpus_queries, evidence_queries, file_queries, ledger_queries, reader_queries, report_queries, stream_queries, structure_queries, text_queries, tool_queries, tree_queries  # noqa: F401
from foliospark.plans.registry import CASES, ORACLES, QUERIES

__all__ = ["CASES", "ORACLES", "QUERIES"]
