"""Readers, fixtures and table operations."""

from vectriage.sources.tables import read_table, TABLES
from vectriage.sources.fixtures import tickets_fx, raw_reviews_fx, TICKETS_AS_OF

__all__ = ["read_table", "TABLES", "tickets_fx", "raw_reviews_fx", "TICKETS_AS_OF"]
