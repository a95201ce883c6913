"""Operators for training-data pipelines: language, quality, toxicity, tokens, duplicates, archives."""
