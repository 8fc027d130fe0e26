"""Operators for training-data pipelines (filtering, dedup, tokenising, packing).

Nothing else in the library imports this subpackage.
"""
