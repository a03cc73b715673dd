"""Semantic object collections on Spark."""
