"""Compositions of operators: feature table, scoring, training, monitoring."""
