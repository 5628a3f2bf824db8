"""Operators on traces, events, images and points; each takes and returns DataFrames."""
