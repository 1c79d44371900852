"""Relational operators: joins, folds, aggregates, ranked retrieval, verification."""
