"""Operators of a training-data pipeline: deduplication, scans, scoring, search, mixing and tokenising of text corpora."""
