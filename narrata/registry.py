"""All queries of the engine's own operators, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from narrata.queries import arriving, cases, claims, documents, lines, reports, scores, splits

MODULES = (documents, lines, reports, cases, claims, splits, scores, arriving)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
