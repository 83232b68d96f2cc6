"""Operators for training-data pipelines: near-duplicates, packing, search, tokens, secrets, language, repeats."""
