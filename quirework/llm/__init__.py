"""Operators for building training data from a corpus of texts."""
