"""Operators for large training-data corpora, with their registered queries.

Nothing else in the library imports this package; ``queries()`` and ``oracle_sql()`` are its door to the registry.
"""

from __future__ import annotations


def queries() -> dict:
    from watchtide.llm import registered
    return dict(registered.QUERIES)


def oracle_sql() -> dict:
    from watchtide.llm import registered
    return dict(registered.ORACLES)
