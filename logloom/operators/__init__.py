"""Relational operators over event, chunk and findings tables."""
