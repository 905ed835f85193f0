"""Operators of a training-data pipeline: deduplication, mixing, filtering,
extraction, scoring, packing and exact search over whole corpora.

Nothing else in the library imports this subpackage.
"""
