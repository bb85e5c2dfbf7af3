"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from termforge.plans import aggregate_queries, annotate_queries, file_queries, filter_queries, golden_queries, lookup_queries, skew_queries, vector_queries

MODULES = [skew_queries, filter_queries, aggregate_queries, lookup_queries, vector_queries, annotate_queries, file_queries]


def queries() -> dict:
    whole = {k: f for m in MODULES for k, f in m.QUERIES.items()}
    golden, _, taken = golden_queries.golden(whole)
    return {f"{k}_all" if k in taken else k: f for k, f in whole.items()} | golden


def oracle_sql() -> dict:
    whole = {k: f for m in MODULES for k, f in m.QUERIES.items()}
    return {k: s for m in MODULES for k, s in m.ORACLE.items()} | golden_queries.golden(whole)[1]
