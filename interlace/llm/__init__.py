"""Operators that prepare text corpora and their annotations as training data. Nothing outside this package imports it."""
