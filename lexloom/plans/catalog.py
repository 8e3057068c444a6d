"""All queries of the library outside the training-data operators, with their SQL."""

from __future__ import annotations

from . import answers, audit, facts, files, questions, streams, texts, vectors, web

_MODULES = (vectors, facts, audit, texts, questions, web, files, streams, answers)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
