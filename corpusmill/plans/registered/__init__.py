"""The registered queries, each next to the SQL that gives the same rows."""

from corpusmill.plans.registered import documents, filters, keywords, search, sources, text, timelines, topics, vectors
from corpusmill.plans.registered.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
