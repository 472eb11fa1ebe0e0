"""Operators for preparing training text: counting, encoding, deduplicating, mixing, writing."""
