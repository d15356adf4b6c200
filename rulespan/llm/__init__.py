"""Operators of a training-data pipeline: language, personal data, duplicates, contamination, sharding, search, tokens."""
