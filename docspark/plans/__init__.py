"""Whole queries built from the operators, and the staging of intermediate tables."""
