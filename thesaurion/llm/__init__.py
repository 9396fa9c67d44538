"""Operators for corpora and training data; nothing outside this package imports it."""
