"""Corpus operators for training-data pipelines: sharding, dedup, mixing, scoring, encoding."""
