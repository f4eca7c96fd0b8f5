"""All queries over the standard tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from tessera.plans import answering, evaluation, retrieval, storing, texts

_PARTS = (texts, retrieval, answering, evaluation, storing)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
