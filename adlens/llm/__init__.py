"""Operators for training-data text and vectors. Nothing else in adlens imports this package."""
