"""Operators of a training-data pipeline: rules, similarity joins, shards, media, mixing, packing, tokens, privacy, classifiers."""
