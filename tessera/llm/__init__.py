"""Operators for training-data pipelines: deduplication, quality, toxicity, mixing and packing.

Nothing outside this subpackage imports it.
"""
