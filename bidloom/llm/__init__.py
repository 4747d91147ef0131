"""Operators of a training-data pipeline: filters, scans, deduplication, scoring, mixing and token output."""
