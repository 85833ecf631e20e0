"""Operators for large text corpora: duplicates, filters, scores, mixing, tokens."""
