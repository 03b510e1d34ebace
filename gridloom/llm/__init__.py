"""Operators for training-data pipelines: text quality, dedup, privacy, tokens, packing, vectors.

Nothing else in the library imports this subpackage.
"""
