"""Operators for preparing training text: language, toxicity and quality, duplicates, tokens, packing, search, archives."""
