"""Operators for preparing training data: extraction, scoring, filtering, deduplication and tokenization.

Nothing else in the library imports this subpackage.
"""
