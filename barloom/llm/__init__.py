"""Operators for preparing training text: dedup, search, tokens, language, privacy, mixing, archives."""
