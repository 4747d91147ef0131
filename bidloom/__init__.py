"""Paid-search analytics as Spark DataFrame operations."""
