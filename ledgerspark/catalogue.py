"""Every reference query by name, with the SQL it is checked against."""

from __future__ import annotations

from ledgerspark.plans import cashflow_queries, coverage_queries, duplicate_queries, evidence_queries, lookup_queries, matching_queries, normalise_queries, review_queries, rule_queries, series_queries, statement_queries, synthetic_queries, training_queries, transition_queries

MODULES = (cashflow_queries, coverage_queries, duplicate_queries, evidence_queries, lookup_queries, matching_queries, normalise_queries, review_queries, rule_queries, series_queries, statement_queries, synthetic_queries, training_queries, transition_queries)


def queries():
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
