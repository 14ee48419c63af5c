"""Operators of a training-data pipeline: quality rules, deduplication, tokens, packing, decontamination."""
