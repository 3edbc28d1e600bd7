"""Operators of a training-data pipeline: near-duplicates, scoring, tokens, packing. Nothing outside imports this."""
