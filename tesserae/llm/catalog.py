"""Queries and SQL of all problems of this subpackage."""

from __future__ import annotations

from tesserae.llm import q_authorship, q_leaks, q_mixture, q_pieces, q_prose, q_runs, q_secrets, q_syntax

_PARTS = [q_syntax, q_runs, q_secrets, q_pieces, q_authorship, q_leaks, q_mixture, q_prose]
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
