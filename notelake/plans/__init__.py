"""Whole programs: search, and the catalogue of queries."""
