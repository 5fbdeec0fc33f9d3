"""Operators for preparing training text: scans, sketches, duplicate search, scoring, tokens and shards."""
