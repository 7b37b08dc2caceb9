"""Operators of a training-data pipeline: deduplication, mixing, tokens, language, quality, URLs."""
