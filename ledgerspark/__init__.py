"""Spark-first analytics over personal-finance ledgers and text corpora."""
