"""Extras: the same aggregates over unbounded input, with watermarks."""
