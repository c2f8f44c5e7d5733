"""Operators for training-data pipelines: tokens, dedup, scans, mixing, packing, search, chat."""
