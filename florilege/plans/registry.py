"""Every registered query and its oracle SQL."""

from __future__ import annotations

from florilege.plans import documents, evidence, fields, files, fits, graph, identities, issues, lexical, markers, operations, passages, references, relational, resolution, resolver, roles, search, statutes, streams, tables, vectors, verification  # noqa: F401  each module registers its queries
from florilege.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
