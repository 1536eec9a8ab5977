"""Operators for training-data pipelines: scoring, near-dedup, personal data, tokens, media, mixing.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
