"""Operators of a text-corpus pipeline: cleaning, deduplication, scoring, mixing and encoding."""
