"""Operators on text corpora for preparing training data, one module each."""
