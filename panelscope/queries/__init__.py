"""Registered queries, one per operator, with the SQL that checks them."""

from . import access, merging, modelling, ranking, response, summary  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
