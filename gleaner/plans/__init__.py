"""Registered queries and their SQL."""

from . import contracts, documents, quality, relations, rules
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "contracts", "documents", "quality", "relations", "rules"]
