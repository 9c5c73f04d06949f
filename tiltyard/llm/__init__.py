"""Operators for text corpora and model training data. Nothing outside this package imports it."""
