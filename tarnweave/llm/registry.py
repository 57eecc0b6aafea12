"""All queries of the training-data operators, and the SQL of those that it can express."""

from __future__ import annotations

from tarnweave.llm import boilerplate, combine, distinctive, markup, mixing, reading, sitelines, stuffed, tokens, topn

_MODULES = (distinctive, combine, boilerplate, markup, topn, sitelines, stuffed, tokens, mixing, reading)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
