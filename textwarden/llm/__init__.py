"""Operators for training-data pipelines: near and exact duplicates, shards, spans, tokens, vectors, languages, scores."""
