"""Queries composed of the operators, bound to tables."""
