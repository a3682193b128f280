"""Registered queries: QUERIES by name, and SQL for those that SQL can express."""

from . import consent_queries, document_queries, file_queries, outcome_queries, record_queries, rule_queries, session_queries, store_queries, task_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
