"""Queries over the supplied tables; importing a module of them registers what it holds."""

from . import activity_queries, answer_queries, code_queries, consistency_queries, graph_queries, history_queries, lookup_queries, question_queries, request_queries, retrieval_queries, security_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
