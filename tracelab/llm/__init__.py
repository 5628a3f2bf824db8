"""Operators for preparing training text, each a module of its own."""
