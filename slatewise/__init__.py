"""Slate events, pattern mining and backtests as Spark DataFrame transformations."""
