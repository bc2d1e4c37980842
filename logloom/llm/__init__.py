"""Operators for the preparation of training text, each in a module of its own."""
