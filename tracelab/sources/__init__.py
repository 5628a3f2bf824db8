"""Readers and writers of traces, tracks, frames and fit results."""
