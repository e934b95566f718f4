"""Operators of a training-data pipeline: URL, quality and license filters, packing, tokens, near-duplicates, search."""
