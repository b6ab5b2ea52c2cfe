"""Operators for training-data preparation: duplicates, quality, leaks, secrets, archives, tokens, packing."""
