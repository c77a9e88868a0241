"""Operators for training-data pipelines. Nothing else in winnow imports this package."""
