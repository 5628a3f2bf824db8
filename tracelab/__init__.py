"""Spark-first analysis of single-molecule traces and images."""
