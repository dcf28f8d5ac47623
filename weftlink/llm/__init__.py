"""Operators for training-data pipelines: tokens, fingerprints, filters, near copies, search, language models."""
