"""Operators for training data: distinctive terms, near duplicates, similar vectors, packing, leaks, truncation."""
