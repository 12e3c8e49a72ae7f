"""Operators for large-scale training-data work on text corpora."""
