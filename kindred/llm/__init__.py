"""Corpus operators for training data: counts, formats, archives, mixing, search, scoring, dedup.

Nothing else in the library imports this subpackage.
"""
