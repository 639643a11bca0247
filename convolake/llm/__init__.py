"""Operators of a training-data pipeline: packing, tokens, duplicates, toxicity, language models, quality, extraction."""
