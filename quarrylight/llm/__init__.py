"""Operators that prepare training data: classification, deduplication, packing, formatting, scans and media columns.

Nothing outside this package imports it; its queries are in ``queries.py``.
"""
