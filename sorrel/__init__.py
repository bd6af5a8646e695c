"""Structured analytics over disclosure facts and editorial text, on Spark."""
