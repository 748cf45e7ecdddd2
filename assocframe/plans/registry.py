"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from assocframe.plans import base, file_queries, join_queries, model_queries, more_queries, profile_queries, raw_queries, scalar_queries, score_queries  # noqa: F401  each module registers its queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
