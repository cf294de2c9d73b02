"""Operators for large text-training corpora, each a DataFrame transformation (see README)."""
