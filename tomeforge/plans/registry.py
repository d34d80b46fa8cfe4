"""All queries of the engine by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import analytics, catalog, documents, evaluation, knowledge, retrieval, tables

MODULES = [documents, tables, retrieval, evaluation, knowledge, catalog, analytics]

QUERIES = {name: query for module in MODULES for name, query in module.R.queries.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.R.oracles.items()}
