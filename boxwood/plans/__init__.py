"""Whole-tree builders, the catalogue of queries, and their SQL."""
