"""Operators for preparing training text: duplicates, scoring, mixing, packing, search, chat."""
