"""Operators for large text corpora: search, packing, near copies, sketches, models, shards, records, tokens.

Nothing else in the library imports this subpackage.
"""
