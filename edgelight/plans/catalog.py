"""Catalogue of the curve queries and their SQL oracles."""

from __future__ import annotations

from edgelight.plans import file_queries, fit_queries, grid_queries, kernel_queries, model_queries, native_queries, reduction_queries, table_queries, view_queries


def queries() -> dict:
    return {**native_queries.QUERIES, **table_queries.QUERIES, **view_queries.QUERIES, **grid_queries.QUERIES, **fit_queries.QUERIES, **model_queries.QUERIES, **kernel_queries.QUERIES, **file_queries.QUERIES, **reduction_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**native_queries.SQL, **table_queries.SQL, **view_queries.SQL, **grid_queries.SQL, **fit_queries.SQL, **model_queries.SQL, **kernel_queries.SQL, **file_queries.SQL, **reduction_queries.SQL}
