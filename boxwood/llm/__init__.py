"""Operators for preparing training data: search, filtering, joins, language models, mixing, packing."""
