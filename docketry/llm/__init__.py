"""Operators of a training-data pipeline: tokens, duplicates, shards, filters, archives."""
