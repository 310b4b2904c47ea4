"""Queries and their oracle SQL, by name."""

from __future__ import annotations

import re

from . import analyses, python_queries
from .dialect import oracle, plan

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name, _text in analyses.TEXTS.items():
    QUERIES[_name] = plan(_text, tuple(sorted(set(re.findall(r"\$(\w+)", _text)))))
    ORACLE_SQL[_name] = oracle(_text)
QUERIES.update(python_queries.QUERIES)
