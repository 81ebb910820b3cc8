"""Operators of a training-data pipeline: scans, tokenizers, near-duplicates, filters."""
